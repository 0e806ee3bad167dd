"""Packing of token sequences into windows by non-negative least squares on the histogram of lengths.

A document is its tokens and one end token. Every full window of it is a sequence of its own; the rest, shorter than a
window, shares a sequence with other rests. The histogram of the rests, one number per length, decides which lengths meet
(``packing_plan``). Documents with rests of one length are interchangeable: each gets a number among them, from running
counts inside the tasks that encode and the sums of the tasks before, and the plan says where that number goes.

The texts are encoded once and the ids written. Only numbers are shuffled to be placed; the ids meet their places by the
row they were written with. A length that very many documents share needs no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.byte_bpe import encoder
from briefloom.llm.common import id_type, ids_and_texts, slices
from briefloom.llm.packing_plan import make_plan
from briefloom.session import materialize, new_path

WINDOW = 2048
END = 1
_BYTES = 4  # of an id


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Ids of every whole text with the end token, and the running counts of the task that encoded it: written once.

    ``__task, __row``: where a row stands; ``full, rest``: full windows and tokens beyond them; ``full_before,
    rest_before``: full windows, and rests of the same length, in earlier rows of the task.
    """
    source = ids_and_texts(docs, id_col, text_col)
    fields = T._parse_datatype_string(
        "__task int, __row long, n_ids long, full long, rest int, full_before long, rest_before long, ids binary"
    ).fields
    out = T.StructType([T.StructField("__id", id_type(docs, id_col)), *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder(tokenizer), np.array([end], "<u4").tobytes()
        task, row, windows = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(window, np.int64)
        for batch in slices(batches):
            ids = [encode(t or "") + stop for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // _BYTES for x in ids], np.int64)
            full, rest = sizes // window, (sizes % window).astype(np.int32)
            before = np.cumsum(full) - full + windows
            order = np.argsort(rest, kind="stable")
            same = np.arange(len(rest)) - np.searchsorted(rest[order], rest[order])
            rest_before = np.empty(len(rest), np.int64)
            rest_before[order] = same
            rest_before += seen[rest]
            seen += np.bincount(rest, minlength=window)
            numbers = np.arange(row, row + len(rest))
            row, windows = row + len(rest), windows + int(full.sum())
            columns = [np.full(len(rest), task, np.int32), numbers, sizes, full, rest, before, rest_before]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type), *map(pa.array, columns), pa.array(ids, pa.binary())], schema=arrow
            )

    path = new_path(docs.sparkSession, "encoded")
    source.mapInArrow(run, out).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out).parquet(path)


def _exclusive_sums(counted: DataFrame, by: list[str], order: str, value: str) -> Column:
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def _placed(rows: DataFrame, window: int) -> DataFrame:
    """(task, row, start, length, sequence, offset) of every piece."""
    # Length 0 stands for full windows, which are sequences by themselves.
    parts = F.array(
        F.struct(F.lit(0).alias("length"), F.col("full").alias("n"), F.col("full_before").alias("before")),
        F.struct(F.col("rest").alias("length"), F.when(F.col("rest") > 0, 1).otherwise(0).cast("long").alias("n"), F.col("rest_before").alias("before")),
    )
    entries = rows.select("__task", "__row", "full", F.inline(parts)).where("n > 0")
    counted = entries.groupBy("length", "__task").agg(F.sum("n").alias("n"))
    # One row per task and length: a length has as many rows here as there are tasks.
    offsets = counted.select("length", "__task", _exclusive_sums(counted, ["length"], "__task", "n").alias("ahead"))
    histogram = np.zeros(window, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # at most ``window`` rows
        histogram[length] = n
    n_full = int(histogram[0])
    plan = make_plan(histogram, window)
    keys, firsts, pieces = _lookup(plan.rows)
    shared = rows.sparkSession.sparkContext.broadcast((keys, firsts, pieces))  # bounded by the window, see packing_plan
    numbered = entries.join(offsets, ["length", "__task"]).select(
        "__task", "__row", "length", "n", (F.col("ahead") + F.col("before")).alias("number"), (F.col("full") * window).alias("skipped")
    )
    schema = "__task int, __row long, start long, length long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, pieces = shared.value
        for batch in batches:
            task, row, length, n, number, skipped = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            whole = length == 0
            at = np.flatnonzero(~whole)
            group = np.searchsorted(keys, length[at].astype(np.int64) << 40 | number[at], side="right") - 1
            many = firsts[group + 1] - firsts[group]
            owner, piece = np.repeat(at, many), _ranges(firsts[group], many)
            got = pieces[piece]
            start, size, shift, offset = got.T if len(got) else np.zeros((4, 0), np.int64)
            big = np.flatnonzero(whole)
            window_owner, k = np.repeat(big, n[big]), _ranges(np.zeros(len(big), np.int64), n[big])
            zero = np.zeros(len(k), np.int64)
            both = np.concatenate([window_owner, owner])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(v)
                    for v in (
                        task[both], row[both], np.concatenate([k * window, skipped[owner] + start]), np.concatenate([zero + window, size]),
                        np.concatenate([number[window_owner] + k, n_full + shift + number[owner]]), np.concatenate([zero, offset]),
                    )
                ],
                names=["__task", "__row", "start", "length", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(run, schema)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``count`` places each, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _lookup(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of numbers by (length, first number), and the pieces of each: start, size, sequence less number, offset."""
    length, first, count, start, size, sequence, offset = rows.T if len(rows) else np.zeros((7, 0), np.int64)
    edges = np.unique(np.concatenate([length << 40 | first, length << 40 | (first + count)]))
    low, high = np.searchsorted(edges, length << 40 | first), np.searchsorted(edges, length << 40 | (first + count))
    row, group = np.repeat(np.arange(len(rows)), high - low), _ranges(low, high - low)
    order = np.lexsort((start[row], group))
    firsts = np.searchsorted(group[order], np.arange(len(edges) + 1))
    return edges, firsts, np.stack([start, size, sequence - first, offset], 1)[row[order]]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """``id_col, start, length, ids, doc_tokens, sequence_id, offset`` of every piece of every document.

    ``ids``: the piece's ids, little-endian unsigned 32-bit numbers; ``start``: ids of its document before it;
    ``doc_tokens``: ids of the document, with the end token; ``offset``: place in the sequence, without gaps. All
    sequences but a few at the end are exactly ``window`` long; those are padded by the reader.

    Null texts count as empty and have the end token only. Repeated rows are packed each on its own, null identifiers
    pass through, other columns are not read, an empty table has no pieces. ``tokenizer`` is a path that every executor
    can open.
    """
    rows = encoded(docs, tokenizer, id_col, text_col, window, end)
    placed = materialize(_placed(rows, window), "placed")
    met = rows.select("__task", "__row", "__id", "n_ids", "ids").join(placed, ["__task", "__row"])
    piece = F.col("ids").substr((F.col("start") * _BYTES + 1).cast("int"), (F.col("length") * _BYTES).cast("int"))
    return met.select(
        F.col("__id").alias(id_col), "start", "length", piece.alias("ids"), F.col("n_ids").alias("doc_tokens"), "sequence_id", "offset"
    )
