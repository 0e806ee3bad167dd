"""Raw items to normalised items (F1) and the recency filter (F2)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.hashing import content_hash, id_from_url
from briefloom.functions.text import strip_html, truncate
from briefloom.functions.urls import with_canonical_url
from briefloom.lexicons.model import Lexicon
from briefloom.operators import lexicon as lx
from briefloom.session import compute_once


@dataclass(frozen=True)
class NormalizeOptions:
    """Length limits of the stored text, if a caller wants any. Whole texts are kept and fingerprinted by default."""

    max_title_chars: int | None = None
    max_snippet_chars: int | None = None
    hash_snippet_chars: int | None = None


@dataclass(frozen=True)
class RecencyOptions:
    lookback_hours: float = 48
    kind_hours: dict[str, float] = field(default_factory=lambda: {"social": 720})


def with_defaults(raw: DataFrame) -> DataFrame:
    """Defaults for columns a collector may leave out (A1)."""
    defaults = {"snippet": F.lit(""), "unverified": F.lit(False), "item_kind": F.lit("news")}
    have = {name: F.coalesce(F.col(name), value) for name, value in defaults.items() if name in raw.columns}
    return raw.withColumns({**defaults, **have})


def normalize_items(
    raw: DataFrame, lexicon: Lexicon, now: Column, options: NormalizeOptions = NormalizeOptions()
) -> DataFrame:
    """Clean, fingerprint and score raw items; rows without a safe link or a title are dropped.

    One narrow stage from the scan to the score: nothing here shuffles.
    """
    linked = with_canonical_url(with_defaults(raw), "link")
    cleaned = compute_once(
        linked,
        {
            "title": truncate(strip_html(F.col("title")), options.max_title_chars),
            "snippet": truncate(strip_html(F.col("snippet")), options.max_snippet_chars),
        },
    ).where(F.col("title") != "")
    keyed = cleaned.withColumns(
        {
            "id": id_from_url(F.col("canonical_url")),
            "content_hash": content_hash(F.col("title"), F.col("snippet"), options.hash_snippet_chars),
            "collected_at": now,
            "coverage_count": F.lit(0).cast("bigint"),
        }
    )
    return lx.score(keyed, lexicon)


def _stale(ts: Column, kind: Column, now: Column, options: RecencyOptions) -> Column:
    hours = F.lit(float(options.lookback_hours))
    for name, value in options.kind_hours.items():
        hours = F.when(kind == name, F.lit(float(value))).otherwise(hours)
    age = F.unix_micros(now) - F.unix_micros(ts)
    return ts.isNotNull() & (age > (hours * F.lit(3600.0 * 1_000_000)).cast("bigint"))


def filter_by_recency(
    df: DataFrame,
    now: Column,
    options: RecencyOptions = RecencyOptions(),
    ts: str = "published_at",
    kind: str = "item_kind",
) -> DataFrame:
    """Drop rows older than the window of their kind; undated and future rows stay."""
    return df.where(~_stale(F.col(ts), F.col(kind), now, options))


def is_recent(now: Column, options: RecencyOptions = RecencyOptions(), ts: str = "published_at", kind: str = "item_kind") -> Column:
    """Whether ``filter_by_recency`` keeps a row."""
    return ~_stale(F.col(ts), F.col(kind), now, options)


def recency_counts(
    df: DataFrame,
    now: Column,
    options: RecencyOptions = RecencyOptions(),
    ts: str = "published_at",
    kind: str = "item_kind",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Kept, dropped and undated rows of the recency filter, in one pass, with ``by`` for each value of these columns."""
    stale = _stale(F.col(ts), F.col(kind), now, options)
    return df.groupBy(*by).agg(
        F.count_if(~stale).alias("kept"),
        F.count_if(stale).alias("dropped_stale"),
        F.count_if(F.col(ts).isNull()).alias("undated"),
    )
