"""Ranked lexical search of query items in a document table, with impacts in whole numbers.

One pass reads the whole texts and keeps of each document its number of terms and those terms that items hold. From this
table come the counts the weights need, exactly and by ordinary aggregates. A second pass reads it in shards of bounded
size; each shard answers all items by the Best Position Algorithm (``best_position``) and starts from the scores that the
shards before it in its task have reached. The best of all tasks are ranked in the end.

Items travel to the tasks in blocks of bounded bytes; a further block is a further pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.best_position import Shard
from briefloom.llm.common import id_type, ids_and_texts, slices
from briefloom.session import materialize

BLOCK_BYTES = 1 << 22
SHARD_POSTINGS = 1 << 21
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and all characters beyond ASCII; only A-Z are lower-cased."""
    return _TERM.findall((text or "").encode().lower())


class Items:
    """A block of items: identifiers, the terms of all of them, and for each item its terms with repeats."""

    def __init__(self, rows: list[tuple]):
        self.names = [name for name, _ in rows]
        found = [Counter(terms_of(text)) for _, text in rows]
        self.vocabulary = {term: i for i, term in enumerate(sorted(set().union(*found)))}
        self.terms = [np.array([self.vocabulary[t] for t in c], np.int64) for c in found]
        self.repeats = [np.array(list(c.values()), np.int64) for c in found]


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``limit`` bytes of text, read partition by partition."""
    block, held = [], 0
    for name, text in items.toLocalIterator():
        block.append((name, text))
        held += 64 + len((text or "").encode())
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def _held_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``__id, n, terms, tfs``: number of terms of each document, and its terms out of ``vocabulary`` with their counts."""
    source = ids_and_texts(docs, id_col, text_col)
    fields = T._parse_datatype_string("n long, terms array<int>, tfs array<int>").fields
    schema = T.StructType([T.StructField("__id", id_type(docs, id_col)), *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in slices(batches):
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                held = Counter(filter(number.__contains__, words))
                sizes.append(len(words))
                terms += [number[t] for t in held]
                tfs += held.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())).cast(arrow.field(2).type) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(sizes, pa.int64()), *lists], schema=arrow)

    return materialize(source.mapInArrow(run, schema), "terms")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for every term."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _shard(parts: list[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int) -> tuple[Shard, pa.Array]:
    """The impact lists of some documents, and their identifiers in the order of ties, nulls last."""
    table = pa.Table.from_batches(parts).combine_chunks()
    table = table.take(pc.sort_indices(table, sort_keys=[("__id", "ascending")], null_placement="at_end"))
    of_doc = np.repeat(np.arange(table.num_rows), pc.list_value_length(table["terms"]).to_numpy())
    terms = pc.list_flatten(table["terms"]).to_numpy().astype(np.int64)
    tf = pc.list_flatten(table["tfs"]).to_numpy().astype(np.int64)
    n = table["n"].to_numpy()
    # Quotient and rest apart: 25 * n * N may not fit 64 bits for the largest tables.
    m = 75 + (25 * n // n_terms) * n_docs + _scaled(25 * n % n_terms, n_docs, n_terms)
    impact = weight[terms] * ((1_000_000_000 * tf) // (1_000 * tf + 12 * m[of_doc]))
    kept = impact > 0
    return Shard(terms[kept], of_doc[kept], impact[kept], len(weight), table.num_rows), table["__id"].combine_chunks()


def _scaled(x: np.ndarray, by: int, over: int) -> np.ndarray:
    """x * by div over, exactly."""
    if len(x) and int(x.max()) * by < 1 << 63:
        return x * by // over
    return np.array([v * by // over for v in x.tolist()], np.int64)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` best documents with a score above 0 for every row of ``items``.

    Equal scores rank by ascending identifier, null last. Every row of either table counts by itself, repeated rows too;
    null texts have no terms; other columns are not read. Items without terms, and empty tables, give no rows. If the
    two identifiers have one name, the document's gets ``doc_`` in front.
    """
    spark = docs.sparkSession
    item_type, doc_type = id_type(items, item_col), id_type(docs, id_col)
    doc_name = id_col if id_col != item_col else f"doc_{id_col}"
    schema = T.StructType(
        [T.StructField("__item", T.IntegerType()), T.StructField(item_col, item_type), T.StructField(doc_name, doc_type), T.StructField("score", T.LongType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ranked = spark.createDataFrame([], T.StructType([schema.fields[1], T.StructField("rank", T.IntegerType()), *schema.fields[2:]]))
    rows = items.select(F.col(f"`{item_col}`"), F.col(f"`{item_text_col}`").cast("string"))
    order = Window.partitionBy("__item").orderBy(F.desc("score"), F.asc_nulls_last(doc_name))
    for block in _blocks(rows, block_bytes):
        wanted = Items(block)
        held = _held_terms(docs, id_col, text_col, wanted.vocabulary).where("n > 0")
        n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(wanted.vocabulary), np.int64)
        for term, n in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of a block
            df[term] = n
        shared = spark.sparkContext.broadcast((wanted.names, wanted.terms, wanted.repeats, weights(df, n_docs)))
        found = held.mapInArrow(_searching(shared, n_docs, n_terms, k, shard_postings, arrow), schema)
        placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.unionByName(placed.select(item_col, "rank", doc_name, "score"))
    return ranked


def _searching(shared, n_docs: int, n_terms: int, k: int, shard_postings: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, repeats, weight = shared.value
        ids: list[list] = [[] for _ in names]
        scores = [np.zeros(0, np.int64) for _ in names]
        least = [1] * len(names)

        def answer(parts: list[pa.RecordBatch]) -> None:
            shard, shard_ids = _shard(parts, weight, n_docs, n_terms)
            for i in range(len(names)):
                docs, found = shard.top(terms[i], repeats[i], k, least[i])
                if len(docs):
                    order = np.lexsort((docs, -found))
                    _add(i, shard_ids.take(pa.array(docs[order])).to_pylist(), found[order])

        def _add(i: int, new_ids: list, new_scores: np.ndarray) -> None:
            both, values = ids[i] + new_ids, np.concatenate([scores[i], new_scores])
            order = sorted(range(len(both)), key=lambda j: (-int(values[j]), both[j] is None, 0 if both[j] is None else both[j]))[:k]
            ids[i], scores[i] = [both[j] for j in order], values[order]
            if len(order) == k:
                least[i] = int(scores[i][-1])

        parts, postings = [], 0
        for batch in batches:
            parts.append(batch)
            postings += pc.sum(pc.list_value_length(batch.column(2))).as_py() or 0
            if postings >= shard_postings:
                answer(parts)
                parts, postings = [], 0
        if parts:
            answer(parts)
        rows = [(i, names[i], doc, int(score)) for i in range(len(names)) for doc, score in zip(ids[i], scores[i])]
        columns = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return run
