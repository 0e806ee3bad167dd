"""Removal of long repeated strings with suffix arrays.

A string of ``length`` bytes that starts at two places of the corpus marks all its bytes at both. To bring equal
strings together without sorting the corpus in one place:

1. Every window of ``length`` bytes has an anchor: the first 64-byte gram of least hash inside it. Windows with one
   anchor are neighbours and form a segment; equal windows have equal anchors. One pass emits the segments as hashes.
2. Anchors with a single segment hold nothing repeated. If all segments of an anchor are equal, all of it repeats.
3. The different segments of other anchors are fetched. Those of one anchor make one text, whose suffix array is built
   by linear grouping (``gsaca``); neighbours in it that agree for ``length`` bytes are repeats.
4. Anchors with more different segments than fit one text (a passage in very many documents) are settled exactly by
   halving: of a range of window starts, the bytes common to all its windows (core) and the bytes that any of them
   covers (hull) are counted. A hull seen twice repeats, a core seen once does not, and the rest is split further.
5. Marks return to the documents, which cut out their own bytes.

Equality of segments in steps 2 and 4 is equality of 64- and 128-bit hashes; step 3 compares bytes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.common import id_type, ids_and_texts, slices, text_bytes, text_or_empty
from briefloom.llm.gsaca import suffix_arrays
from briefloom.operators.graph import salted_lookup
from briefloom.session import materialize

LENGTH = 400
GRAM = 64
UNIT_SEGMENTS = 24  # different segments of one suffix array at most
UNIT_BYTES = 1 << 21  # bytes of suffix arrays that advance together
_SLICE = 1 << 21
_SPLIT = 4


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    n = len(data)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        back = np.full(n - size + 1, _inverse(_BASE), np.uint64)
        back[0] = 1
        h = (sums[size:] - sums[:-size]) * np.cumprod(back)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, first and last window start within the text, anchor place and anchor hash of every segment."""
    big = np.flatnonzero(np.diff(offsets) >= length)
    none = np.zeros(0, np.int64)
    if not len(big):
        return none, none, none, none, none.view(np.uint64)
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    chosen = np.empty(len(hashes) - width + 1, np.int64)
    step = (1 << 22) - width
    for start in range(0, len(chosen), step):
        part = hashes[start : start + step + width - 1]
        # Hash in the upper bits, place in the lower ones: of equal hashes the first place wins.
        mixed = (part >> np.uint64(22) << np.uint64(22)) | np.arange(len(part), dtype=np.uint64)
        chosen[start : start + step] = (window_least(mixed, width) & np.uint64((1 << 22) - 1)).astype(np.int64) + start
    edge = np.zeros(len(chosen) + 1, np.int64)
    np.add.at(edge, offsets[big], 1)
    np.add.at(edge, offsets[big + 1] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= (chosen[1:] != chosen[:-1]) | ~valid[:-1]
    fresh[offsets[big]] = True
    first = np.flatnonzero(fresh)
    last_valid = valid & ~np.concatenate([valid[1:] & ~fresh[1:], [False]])
    last = np.flatnonzero(last_valid)
    text = np.searchsorted(offsets, first, side="right") - 1
    return text, first - offsets[text], last - offsets[text], chosen[first] - offsets[text], hashes[chosen[first]]


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.md5(data).digest()[:8], "little", signed=True)


def _segment_rows(texts: DataFrame, length: int) -> DataFrame:
    """Segments of all texts: identity of the text, window starts, anchor hash, hash of the segment's bytes."""
    kind = id_type(texts, "__id")
    schema = T.StructType([T.StructField("__id", kind), *T._parse_datatype_string("__key long, s0 int, s1 int, anchor long, piece long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SLICE):
            data, offsets = text_bytes(batch.column(2))
            text, s0, s1, _, anchor = segments(data, offsets, length)
            raw, at = data.tobytes(), offsets[text]
            pieces = [_digest(raw[a:b]) for a, b in zip((at + s0).tolist(), (at + s1 + length).tolist())]
            rows = pa.array(text, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s0, pa.int32()), pa.array(s1, pa.int32()),
                    pa.array(anchor.view(np.int64)), pa.array(pieces, pa.int64()),
                ],
                names=["__id", "__key", "s0", "s1", "anchor", "piece"],
            )

    return texts.mapInArrow(run, schema)


def _fetch(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of one occurrence of each wanted (anchor, piece)."""
    by_text = wanted.groupBy("at.__id", "at.__key").agg(F.collect_list(F.struct("anchor", "piece", "n", F.col("at.s0").alias("s0"), F.col("at.s1").alias("s1"))).alias("list"))
    by_text = by_text.select(F.col("__id").alias("__wid"), F.col("__key").alias("__wkey"), "list")
    joined = texts.join(by_text, F.col("__id").eqNullSafe(F.col("__wid")) & (F.col("__key") == F.col("__wkey"))).select("__text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [
                (x["anchor"], x["piece"], x["n"], raw[x["s0"] : x["s1"] + length])
                for text, wanted_here in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for raw in [text.encode()]
                for x in wanted_here
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                names=["anchor", "piece", "n", "bytes"],
            )

    return joined.mapInArrow(run, "anchor long, piece long, n long, bytes binary").dropDuplicates(["anchor", "piece"])


def repeated_starts(units: list[list[tuple[bytes, int]]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """For each unit of (bytes, occurrences): the window starts of every segment that occur more than once.

    One text per unit: its segments with a low symbol behind each, and the lowest at the end. In the suffix array of
    the unit, equal windows are neighbours.
    """
    sizes = np.array([sum(len(b) + 1 for b, _ in u) for u in units], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.frombuffer(b"".join(b + b"\0" for u in units for b, _ in u), np.uint8)
    lengths = np.array([len(b) for u in units for b, _ in u], np.int64)
    ends = np.cumsum(lengths + 1)
    symbols = joined.astype(np.int64) + 2
    symbols[ends - 1] = 1
    symbols[offsets[1:] - 1] = 0
    order = suffix_arrays(symbols, offsets)
    # Starts of whole windows, in suffix order.
    windows = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(windows, ends - 1 - lengths, 1)
    np.add.at(windows, ends - length, -1)
    whole = np.cumsum(windows[:-1]) > 0
    order = order[whole[order]]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        unit = np.searchsorted(offsets, order, side="right")
        like = np.flatnonzero((unit[1:] == unit[:-1]) & (joined[a] == joined[b]) & (joined[a + length - 1] == joined[b + length - 1]))
        for k in range(0, len(like), 1 << 14):
            part = like[k : k + (1 << 14)]
            reach = np.arange(length)
            same[part + 1] = (joined[a[part][:, None] + reach] == joined[b[part][:, None] + reach]).all(axis=1)
    again = np.zeros(len(symbols), bool)
    again[order[same]] = True
    again[order[np.flatnonzero(same) - 1]] = True
    often = np.repeat(np.array([n > 1 for u in units for _, n in u]), lengths + 1)
    again |= often & whole
    out, k = [], 0
    firsts = ends - 1 - lengths
    for u in units:
        out.append([np.flatnonzero(again[firsts[k + i] : firsts[k + i] + lengths[k + i]]) for i in range(len(u))])
        k += len(u)
    return out


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


def _by_suffix_array(rows: DataFrame, length: int) -> DataFrame:
    """Marks (anchor, piece, a, b) of units; rows arrive sorted by anchor."""

    def marks(units: list[tuple[int, list[tuple[int, bytes, int]]]]) -> pa.RecordBatch:
        found = repeated_starts([[(x[1], x[2]) for x in u] for _, u in units], length)
        rows = [(anchor, x[0], a, b) for (anchor, u), starts in zip(units, found) for x, s in zip(u, starts) for a, b in _ranges(s)]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["anchor", "piece", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Finished units wait by size class, so that those that advance together have about the same length.
        waiting: dict[int, list[tuple[int, list]]] = defaultdict(list)
        held: dict[int, int] = defaultdict(int)
        unit: tuple[int, list] | None = None

        def finish(done: tuple[int, list]) -> Iterator[pa.RecordBatch]:
            size = sum(len(x[1]) for x in done[1])
            kind = size.bit_length()
            waiting[kind].append(done)
            held[kind] += size
            if held[kind] >= UNIT_BYTES:
                yield marks(waiting.pop(kind))
                held[kind] = 0

        for batch in batches:
            for anchor, piece, n, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if unit is None or unit[0] != anchor:
                    if unit is not None:
                        yield from finish(unit)
                    unit = (anchor, [])
                unit[1].append((piece, data, n))
        if unit is not None:
            yield from finish(unit)
        for units in waiting.values():
            yield marks(units)

    return rows.mapInArrow(run, "anchor long, piece long, a int, b int")


def _parts(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Cut the window ranges of segments at multiples of ``width`` before the anchor; hashes of core and hull of each part.

    ``lo .. hi``: distances of window starts from the anchor; ``bytes``: from the window that starts ``hi`` before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, piece, n, lo, hi, data in zip(*(batch.column(k).to_pylist() for k in range(6))):
                head = anchor.to_bytes(8, "little", signed=True)
                for block in range(lo // width, hi // width + 1):
                    low, high = max(lo, block * width), min(hi, block * width + width - 1)
                    hull = data[hi - high : hi - low + length]
                    # Common to all windows of the block, also where the segment has only some of them.
                    core = data[hi - block * width : hi - (block * width + width - 1) + length]
                    tag = head + block.to_bytes(4, "little")
                    out.append((anchor, piece, n, low, high, hull, hashlib.md5(tag + b"c" + core).digest(), hashlib.md5(tag + b"h" + hull).digest()))
            columns = list(zip(*out)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["anchor", "piece", "n", "lo", "hi", "bytes", "core", "hull"])

    return rows.mapInArrow(run, "anchor long, piece long, n long, lo int, hi int, bytes binary, core binary, hull binary")


def _by_halving(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Marks (anchor, piece, lo, hi) of segments (anchor, piece, n, lo, hi, bytes), as distances before the anchor."""
    width = 1
    while 2 * width * _SPLIT <= length - gram + 1:
        width *= _SPLIT
    found = None
    while True:
        parts = materialize(_parts(rows, width, length), "parts")
        cores = parts.groupBy("core").agg(F.sum("n").alias("n_core"))
        hulls = parts.groupBy("hull").agg(F.sum("n").alias("n_hull"))
        salt = parts.withColumn("salt", F.xxhash64("anchor", "piece", "lo"))
        judged = materialize(salted_lookup(salted_lookup(salt, "core", cores, "salt"), "hull", hulls, "salt").drop("core", "salt"), "judged")
        sure = judged.where("n_hull > 1").select("anchor", "piece", "lo", "hi")
        found = sure if found is None else found.unionByName(sure)
        if width == 1:
            return found
        columns = ["anchor", "piece", "n", "lo", "hi", "bytes"]
        rest = judged.where("n_hull = 1 and n_core > 1").select(*columns)
        if rest.isEmpty():
            return found
        # Settled hulls go along once each, with their number, where another hull has the same core.
        witnesses = judged.where("n_hull > 1 and n_core > n_hull").dropDuplicates(["hull"]).withColumn("n", F.col("n_hull")).select(*columns)
        rows, width = rest.unionByName(witnesses), width // _SPLIT


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, unit_segments: int = UNIT_SEGMENTS) -> DataFrame:
    """Window ranges (__id, __key, a, b) of texts (__id, __key, __text) that also start elsewhere."""
    all_segments = materialize(_segment_rows(texts, length), "segments")
    shared = (
        all_segments.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high"))
        .where("n > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    )
    shared = materialize(shared, "anchors")
    found = materialize(all_segments.join(shared, "anchor").select("__id", "__key", "s0", "s1", "anchor", "piece", "mixed"), "shared")
    place = F.struct("__id", "__key", "s0", "s1")
    wanted = found.where("mixed").groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    fetched = materialize(_fetch(texts, wanted, length), "pieces")
    counts = fetched.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces"))
    counts = materialize(counts, "counts")
    sized = fetched.join(counts, "anchor")
    small = sized.where(F.col("pieces") <= unit_segments).select("anchor", "piece", "n", "bytes")
    marks = _by_suffix_array(small.repartition("anchor").sortWithinPartitions("anchor", "piece"), length)
    many = sized.where(F.col("pieces") > unit_segments).select("anchor", "piece", "n", "bytes")
    many = materialize(_anchored(many, length, gram), "many")
    if not many.isEmpty():
        halved = _by_halving(many, length, gram)
        reach = many.select("anchor", "piece", F.col("hi").alias("reach"))
        back = halved.join(reach, ["anchor", "piece"]).select("anchor", "piece", (F.col("reach") - F.col("hi")).alias("a"), (F.col("reach") - F.col("lo")).alias("b"))
        marks = marks.unionByName(back)
    marks = materialize(marks, "marks")
    ranges = found.where("mixed").join(marks, ["anchor", "piece"]).select("__id", "__key", (F.col("s0") + F.col("a")).alias("a"), (F.col("s0") + F.col("b")).alias("b"))
    whole = found.where("not mixed").select("__id", "__key", F.col("s0").alias("a"), F.col("s1").alias("b"))
    return whole.unionByName(ranges)


def _anchored(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Add the distances of the first and last window start before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for data in batch.column(3).to_pylist():
                raw = np.frombuffer(data, np.uint8)
                anchor = int(segments(raw, np.array([0, len(raw)]), length, gram)[3][0])
                high.append(anchor)
                low.append(anchor - (len(raw) - length))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(low, pa.int32()), pa.array(high, pa.int32()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "piece", "n", "lo", "hi", "bytes"])

    return rows.mapInArrow(run, "anchor long, piece long, n long, lo int, hi int, bytes binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, unit_segments: int = UNIT_SEGMENTS) -> DataFrame:
    """``id_col, n_bytes, removed array<struct<start, end>>, kept binary`` of every whole text as UTF-8 bytes.

    Removed is each byte that a string of ``length`` bytes covers which also starts anywhere else, in the same document
    included; overlaps count, and all strings are judged on the input. Matches never cross documents. ``removed``:
    maximal runs; ``kept``: the other bytes, not always valid UTF-8. Null counts as empty; shorter texts are kept whole.
    Repeated rows are different places: both lose what they share. Null identifiers pass through; an empty table gives
    an empty result; other columns are not read.
    """
    texts = ids_and_texts(docs, id_col, text_col).withColumn("__text", text_or_empty(F.col("__text")))
    texts = texts.select("__id", F.xxhash64("__text").alias("__key"), "__text")
    spans = repeated_spans(texts, length, unit_segments=unit_segments).distinct()
    spans = spans.groupBy("__id", "__key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = spans.select(F.col("__id").alias("__sid"), F.col("__key").alias("__skey"), "spans")
    joined = texts.join(spans, F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__key") == F.col("__skey")), "left").select("__id", "__text", "spans")
    schema = T.StructType([T.StructField("__id", id_type(docs, id_col)), *T._parse_datatype_string("n_bytes long, removed array<struct<start:int,end:int>>, kept binary").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, removed, kept = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                runs: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"] + length) for x in ranges or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                sizes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, arrow.field(2).type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return joined.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
