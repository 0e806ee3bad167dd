"""Fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions.text import spaced_words


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def id_from_url(canonical_url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a canonical URL."""
    return F.substring(sha256(canonical_url), 1, 16)


def content_hash(title: Column, snippet: Column, snippet_chars: int | None = None) -> Column:
    """Fingerprint of a story (C11): words of the title and of the snippet.

    ``snippet_chars`` limits the snippet to its first characters, where fingerprints of another system must be met.
    """
    body = spaced_words(F.coalesce(snippet, F.lit("")))
    if snippet_chars is not None:
        body = F.substring(body, 1, snippet_chars)
    head = spaced_words(F.coalesce(title, F.lit("")))
    return F.substring(sha256(F.concat(head, F.lit("|"), body)), 1, 24)
