"""Benchmark decontamination with an FM-index per shard of the training text.

The benchmark gives windows of ten words (a shorter item gives one window). A shard is a few megabytes of documents.
Runs of words whose neighbouring pairs all occur in the benchmark go into the shard's index: suffix array, its
Burrows-Wheeler transform in a wavelet matrix with rank counts, and sampled suffix positions. All windows are searched
backwards at once, their occurrences located from the samples, and the words they cover merged into removal spans.

The pair filter only leaves out places where no window can be; the index decides. Benchmark items are handed to the
tasks in blocks of bounded bytes. With more than one block the documents pass once per block, and what was found so
far travels along.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.common import ROWS_AT_ONCE, byte_cuts, id_type, ids_and_texts, prepare, slices, text_bytes, text_or_empty, text_sizes
from briefloom.session import materialize

WINDOW = 10
#: Bytes of items in a block: at most so many windows, some 40 bytes each, and one entry per different word.
BLOCK_BYTES = 1 << 23
_SAMPLE = 8
_PAIR_BITS = 22

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_bytes(data: np.ndarray) -> bytes:
    return _LOWER[data].tobytes()


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every text the number of its first word. No word crosses texts."""
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit mixtures of first and last eight bytes and length, in lower case: equal words have equal keys.

    Different words of more than 16 bytes may share a key, so this only filters.
    """
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8:-8] = _LOWER[data]
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
    size = np.minimum(ends - starts, 8).astype(np.uint64)
    cut = (np.uint64(8) - size) << np.uint64(3)
    with np.errstate(over="ignore"):
        head, tail = eight[starts + 8] << cut, eight[ends] >> cut
        key = head * np.uint64(0x9E3779B97F4A7C15) + tail * np.uint64(0xC2B2AE3D27D4EB4F) + (ends - starts).astype(np.uint64)
        key ^= key >> np.uint64(29)
        return key * np.uint64(0xBF58476D1CE4E5B9)


def _pair_slots(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ keys[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIR_BITS)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    low = _LOWER[data].tobytes() if len(starts) * 50 > len(data) else None
    if low is not None:
        return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    return [_LOWER[data[a:b]].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]


class Windows:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        texts = [t.encode() for _, t in items]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts, ends, firsts = word_places(data, offsets)
        words, keys = _words(data, starts, ends), word_keys(data, starts, ends)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted(set(words)))}  # 0: anything else
        ids = np.array([self.vocabulary[w] for w in words], np.int32)
        self.names = [name for name, _ in items]
        # By length: the different windows as rows of word numbers, and which items hold each (places in the last array).
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.diff(firsts)
        lengths = np.minimum(sizes, window)
        for length in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == length)
            per = sizes[own] - length + 1
            begin = np.repeat(firsts[own] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            rows, which = np.unique(np.lib.stride_tricks.sliding_window_view(ids, length)[begin], axis=0, return_inverse=True)
            held = np.unique(which.ravel() * len(items) + np.repeat(own, per))
            self.groups.append((rows, np.searchsorted(held // len(items), np.arange(len(rows) + 1)), held % len(items)))
        self.shortest = min((rows.shape[1] for rows, _, _ in self.groups), default=0)
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        inner = np.ones(max(0, len(ids) - 1), bool)
        inner[firsts[(firsts > 0) & (firsts < len(ids))] - 1] = False
        if len(keys) > 1:
            self.pairs[_pair_slots(keys)[inner]] = True


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of small numbers, by doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class FmIndex:
    """Backward search and location in one shard."""

    def __init__(self, text: np.ndarray):
        text = np.append(text.astype(np.int64) + 1, 0)  # 0 ends the text
        self.n, top = len(text), int(text.max()) + 1
        order = suffix_array(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        bwt = text[order - 1]
        self.bits = max(1, int(top - 1).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each place, per level
        self.zeros: list[int] = []
        level = bwt
        for shift in range(self.bits - 1, -1, -1):
            bit = (level >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        kept = (order % _SAMPLE == 0) | (order == 0)
        self.sampled, self.kept = order[kept], kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before its place."""
        low = np.zeros(len(place), np.int64)
        high = place.astype(np.int64)
        for level, shift in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level]
            bit = ((symbol >> shift) & 1).astype(bool)
            low = np.where(bit, self.zeros[level] + ones[low], low - ones[low])
            high = np.where(bit, self.zeros[level] + ones[high], high - ones[high])
        return high - low

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each window, given as rows of symbols: read from the last to the first."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for column in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[live, column].astype(np.int64) + 1
            known = symbol < len(self.before) - 1
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a sampled one, at most eight steps."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.kept[rows[live]]
            at = live[hit]
            out[at] = self.sampled[self.kept_before[rows[at]]] + steps[at]
            live = live[~hit]
            symbol = self.bwt[rows[live]]
            rows[live] = self.before[symbol] + self.rank(symbol, rows[live])
            steps[live] += 1
        return out


def _runs(ids_ok: np.ndarray, firsts: np.ndarray, n: int, shortest: int) -> np.ndarray:
    """Words that stand in a run of at least ``shortest`` words whose neighbouring pairs are all possible."""
    if shortest <= 1:
        return np.arange(n)
    joined = np.append(ids_ok, False)
    inner = firsts[(firsts > 0) & (firsts < n)] - 1
    joined[inner] = False
    change = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
    begin, stop = change[::2], np.minimum(change[1::2] + 1, n)  # a run of pairs covers one word more
    keep = stop - begin >= shortest
    begin, stop = begin[keep], stop[keep]
    sizes = stop - begin
    return np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def search_shard(column: pa.Array, known: Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[tuple[int, int]]], list[set[int]]]:
    """Per text: number of words, hit spans in words, the same in bytes, and the items that occur."""
    data, offsets = text_bytes(column)
    starts, ends, firsts = word_places(data, offsets)
    counts = np.diff(firsts)
    n_texts = len(counts)
    words: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    places: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    items: list[set[int]] = [set() for _ in range(n_texts)]
    n = len(starts)
    if not n or not known.groups:
        return counts, words, places, items
    if known.shortest > 1:
        possible = known.pairs[_pair_slots(word_keys(data, starts, ends))] if n > 1 else np.zeros(0, bool)
        chosen = _runs(possible, firsts, n, known.shortest)
    else:
        chosen = np.arange(n)
    if not len(chosen):
        return counts, words, places, items
    ids = np.array([known.vocabulary.get(w, 0) for w in _words(data, starts[chosen], ends[chosen])], np.int32)
    # A separator wherever two chosen words are not neighbours in one text.
    owner = np.searchsorted(firsts, chosen, side="right") - 1
    gap = np.flatnonzero((np.diff(chosen) != 1) | (np.diff(owner) != 0)) + 1
    text, where = np.insert(ids, gap, 0), np.insert(chosen, gap, -1)
    index = FmIndex(text)
    present = np.zeros(len(known.vocabulary) + 1, bool)
    present[ids] = True
    cover = np.zeros(n + 1, np.int64)
    for every, first_item, holders in known.groups:
        size = every.shape[1]
        numbers = np.flatnonzero(present[every].all(axis=1))
        rows = every[numbers]
        low, high = index.search(rows)
        found = high - low
        if not found.sum():
            continue
        suffixes = np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())
        first = where[index.locate(suffixes)]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + size, -1)
        doc = np.searchsorted(firsts, first, side="right") - 1
        for d, k in np.unique(np.stack([doc, np.repeat(numbers, found)]), axis=1).T.tolist():
            items[d].update(holders[first_item[k] : first_item[k + 1]].tolist())
    hit = np.cumsum(cover[:n]) > 0
    edge = hit.copy()
    edge[firsts[(firsts > 0) & (firsts < n)]] = False  # spans end with their text
    begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & edge[1:]]))
    stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & edge[1:], [False]])) + 1
    for a, b, d in zip(begin.tolist(), stop.tolist(), (np.searchsorted(firsts, begin, side="right") - 1).tolist()):
        words[d].append((a - int(firsts[d]), b - int(firsts[d])))
        places[d].append((int(starts[a] - offsets[d]), int(ends[b - 1] - offsets[d])))
    return counts, words, places, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps or touching neighbours."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in blocks of at most ``limit`` bytes of text, read partition by partition."""
    block, held = [], 0
    for name, text in items.toLocalIterator():
        block.append((name, text))
        held += len(text.encode())
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


_SPANS = "array<struct<start:int,end:int>>"
_SHIPPED: dict[int, Windows] = {}


def _ship(docs: DataFrame, known: Windows):
    """Send a block of windows to the executors: a bounded broadcast, and a number to know it by."""
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps(known)), uuid.uuid4().int


def _windows(shipped, number: int) -> Windows:
    """The block in this worker; only the last one is held."""
    if number not in _SHIPPED:
        _SHIPPED.clear()
        _SHIPPED[number] = pickle.loads(shipped.value)
    return _SHIPPED[number]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id_col, n_words, word_spans, byte_spans, items, contaminated`` of every whole text.

    ``word_spans``: maximal runs of hit words, as word numbers; ``byte_spans``: the same as places in the UTF-8 text,
    to be removed; ``items``: identifiers, as strings in string order, of the items with an occurring window.
    Null texts have no words, on either side. Repeated item identifiers are one item, a null one is written as an empty
    string. One row per input row, repeated rows included; null identifiers pass through; other columns are not read.
    An empty benchmark contaminates nothing. No shuffle.
    """
    key = id_type(docs, id_col)
    found = ids_and_texts(docs, id_col, text_col).select(
        "__id", "__text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("word_spans"),
        F.array().cast(_SPANS).alias("byte_spans"), F.array().cast("array<string>").alias("items"),
    )
    schema = T.StructType([T.StructField("__id", key), *found.schema.fields[1:]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def searching(shipped, number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _windows(shipped, number)
            for batch in slices(batches):
                counts, words, places, items = search_shard(batch.column(1), known)
                so_far = [batch.column(k).to_pylist() for k in (3, 4, 5)]
                spans = [
                    [[{"start": a, "end": b} for a, b in merge_spans(new + [(x["start"], x["end"]) for x in old])] for new, old in zip(fresh, known_spans)]
                    for fresh, known_spans in zip((words, places), so_far)
                ]
                names = [sorted({*old, *(known.names[k] for k in new)}) for new, old in zip(items, so_far[2])]
                columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), *[pa.array(v, arrow.field(k).type) for k, v in ((3, spans[0]), (4, spans[1]), (5, names))]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        return run

    texts = F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit(""))
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")), texts)
    passes = 0
    for block in _blocks(rows, block_bytes):
        if passes:
            found = materialize(found, "contamination")
            shipped.unpersist()  # its pass is over
        shipped, number = _ship(docs, Windows(block, window))
        found = found.mapInArrow(searching(shipped, number), schema)
        passes += 1
    if not passes:
        found = found.mapInArrow(searching(*_ship(docs, Windows([], window))), schema)
    return found.select(
        F.col("__id").alias(id_col), "n_words", "word_spans", "byte_spans", "items", (F.size("word_spans") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit word, with all their columns. Each block of the benchmark is one more filter.

    Null and empty texts have no words and stay; repeated rows and rows without identifier are judged by their text alone;
    an empty benchmark removes nothing, an empty table gives an empty one.
    """
    prepare(docs.sparkSession)

    def clean(shipped, number: int):
        @F.arrow_udf(T.BooleanType())
        def test(texts: pa.Array) -> pa.Array:
            known = _windows(shipped, number)
            out: list[bool] = []
            for start, stop in byte_cuts(text_sizes(texts), ROWS_AT_ONCE):
                out += [not spans for spans in search_shard(texts.slice(start, stop - start), known)[1]]
            return pa.array(out, pa.bool_())

        return test(text_or_empty(F.col(f"`{text_col}`").cast("string")))

    texts = benchmark.select(F.lit(""), text_or_empty(F.col(f"`{item_text_col}`").cast("string")))
    for block in _blocks(texts, block_bytes):
        docs = docs.where(clean(*_ship(docs, Windows(block, window))))
    return docs
