"""Secrets: fixed patterns, and strings in a sensitive context that a primed compressor cannot shorten.

Each candidate is a long run of key characters close behind a sensitive word. It is compressed alone with zstandard, in
short pieces, primed with the text before it and with a dictionary of common identifiers; the bytes it adds are its novelty. Names,
paths and repeated values are found in the dictionary and add few bytes, random keys add nearly all of theirs.
Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame

from briefloom.llm.common import map_batches

KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SENSITIVE = re.compile(r"(?:pass|secret|token|key|auth|bearer|credential|private|signature|session)", re.IGNORECASE | re.ASCII)

AROUND = 1 << 11  # code points of text before a string that prime the compressor
PIECE = 60  # characters compressed at once; from 64 literals on zstandard would code their frequencies
LEAST = 20  # characters of a candidate
BEHIND = 48  # a candidate begins at most so far behind the sensitive word
#: Words of configuration and code; values made of them are names, not keys.
IDENTIFIERS = " ".join(
    """access account address admin algorithm application auth authorization base64 bearer bucket certificate client config
    connection container content credential database default description development document endpoint environment example
    expires factory false function handler header hostname identifier instance interface internal key language local
    localhost message method module namespace null object option parameter password path placeholder port private
    production profile project property provider public reference region register repository request resource response
    sample schema secret security server service session signature source staging storage string subscription system
    template test token true type undefined update user username value version your abcdefghijklmnopqrstuvwxyz
    ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 XXXXXXXXXXXXXXXX xxxxxxxxxxxxxxxx 00000000000000000000""".split()
)
_FILLERS = 6  # so many at the end are no words
_FORMAT = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)


def _compressed(data: bytes, primer: bytes) -> int:
    primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(dict_data=primed, compression_params=_FORMAT).compress(data))


_EMPTY = _compressed(b"", IDENTIFIERS.encode())


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that the string adds behind the text before it and the identifiers, as a share of its length.

    It is compressed by pieces, each primed with what stands before it: zstandard leaves so few literals as they are, so
    a long string or a small alphabet is not taken for known text. What follows does not prime, so that of two copies
    the first is novel.
    """
    n = -(-(end - start) // PIECE)
    cuts = [start + (end - start) * k // n for k in range(n + 1)]
    added = 0
    for a, b in zip(cuts, cuts[1:]):
        before = text[max(0, a - AROUND) : a]
        added += max(0, _compressed(text[a:b].encode(), (IDENTIFIERS + "\n" + before).encode()) - _EMPTY)
    return added / (end - start)


def _pair_costs() -> dict[str, float]:
    """Bits that each pair of letters costs more or less in a code of the identifiers than in a plain one."""
    pairs = Counter(w[k : k + 2].lower() for w in IDENTIFIERS.split()[:-_FILLERS] for k in range(len(w) - 1))
    first = Counter()
    for pair, n in pairs.items():
        first[pair[0]] += n
    letters = string.ascii_lowercase
    return {x + y: math.log2(26 * (pairs[x + y] + 0.1) / (first[x] + 2.6)) for x in letters for y in letters}


_COSTS = _pair_costs()


def worded(value: str) -> bool:
    """Whether a string without digits is made of words: letter pairs as in identifiers make its code shorter.

    Of random strings of 20 letters this takes one in 800 for words, of longer ones fewer.
    """
    low = value.lower()
    return not any(c.isdigit() for c in low) and sum(_COSTS.get(low[k : k + 2], 0.0) for k in range(len(low) - 1)) > 0


def _copies(text: str, values: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """All places of the values, also inside longer runs, in one pass over the candidates."""
    heads: dict[str, list[str]] = {}
    for value in sorted(values, key=len, reverse=True):
        heads.setdefault(value[:LEAST], []).append(value)
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        while at <= m.end() - LEAST:
            value = next((v for v in heads.get(text[at : at + LEAST], ()) if text.startswith(v, at)), None)
            if value is not None:
                yield value, at, at + len(value)
            at += len(value) if value is not None else 1


def spans(text: str, threshold: float = 0.8) -> list[dict]:
    """All spans of a text by start and kind: fixed patterns, then novel strings outside them, with all their copies."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    out = [{"kind": k, "start": a, "end": b, "novelty": None, "base": True} for k, a, b in found]
    taken: list[list[int]] = []  # the places of fixed patterns, without overlaps
    for a, b in sorted((a, b) for _, a, b in found):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    at, novel = 0, {}
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        free, done = 0, a  # the longest part outside fixed patterns
        while at < len(taken) and taken[at][0] < b:
            free, done = max(free, taken[at][0] - done), taken[at][1]
            if done >= b:
                break
            at += 1
        if max(free, b - done) < LEAST or not _SENSITIVE.search(text, max(0, a - BEHIND), a):
            continue
        if m[0] not in novel and not worded(m[0]) and (share := novelty(text, a, b)) >= threshold:
            novel[m[0]] = share
    if novel:
        at = 0
        for value, a, b in _copies(text, novel):
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if not (at < len(taken) and taken[at][0] <= a and b <= taken[at][1]):
                out.append({"kind": "novel", "start": a, "end": b, "novelty": novel[value], "base": False})
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``id_col, spans array<struct<kind, start, end, novelty, base>>`` of every whole text.

    Null and empty texts have an empty list. One row per input row, repeated rows included, null identifiers pass
    through; other columns are not read. ``novelty`` is null for the fixed patterns. A projection without a shuffle.
    """
    span = "array<struct<kind:string,start:int,end:int,novelty:double,base:boolean>>"
    return map_batches(docs, id_col, text_col, f"spans {span}", lambda texts: {"spans": [spans(x, threshold) for x in texts]})
