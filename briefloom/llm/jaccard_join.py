"""Similarity join of whole texts on word n-grams, by MinHash banding with verification on the full sets.

1. Every text becomes its set of hashed word n-grams; texts with equal sets are one entry from here on.
2. A signature of minima is cut into bands. Bands and rows follow from the threshold and the target recall.
3. Entries are shuffled on band hashes. Each links to the smallest entry of its band bucket, not to all others, so a
   bucket of any size gives one link per entry. Connected entries are candidates of each other.
4. The full sets of candidates are compared exactly. A large candidate group is cut into blocks of bounded size, and
   every pair of blocks is one unit of work; units return sums per entry and a spanning set of links, never all pairs.
5. Verified links give the classes; every document gets its class and its number of links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.common import id_type, ids_and_texts, slices, text_bytes
from briefloom.llm.decontam import lower_bytes, word_keys, word_places
from briefloom.operators.graph import connected, salted_lookup
from briefloom.session import materialize

N_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 128
BLOCK_SETS = 64
BLOCK_ITEMS = 1 << 20
_COMMON = 32  # n-grams in more sets of a unit than this are counted by a matrix product


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows, hence fewest false candidates, whose recall at the threshold is met."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def whole_word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of all bytes of every word, in lower case. Up to 16 bytes, first and last eight are the word."""
    keys = word_keys(data, starts, ends)
    long = np.flatnonzero(ends - starts > 16)
    if len(long):
        low = lower_bytes(data)
        keys[long] = np.frombuffer(
            b"".join(hashlib.blake2b(low[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())), "<u8"
        )
    return keys


def ngram_sets(column: pa.Array, n_words: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one after another, and their bounds.

    Words are runs of letters and digits, A-Z in lower case, as in the benchmark search. A text with fewer words has one
    n-gram of all its words; a text without words has none.
    """
    data, offsets = text_bytes(column)
    starts, ends, firsts = word_places(data, offsets)
    n = len(column)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    keys = whole_word_keys(data, starts, ends)
    words = np.diff(firsts)
    grams = np.where(words > 0, np.maximum(1, words - n_words + 1), 0)
    owner = np.repeat(np.arange(n), grams)
    first = firsts[owner] + np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(grams)[:-1]]), grams)
    size = np.minimum(words, n_words)[owner]
    value = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n_words):
            has = size > k
            value[has] = (value[has] ^ keys[first[has] + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(31)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(n + 1))


def band_hashes(values: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of every non-empty set, one row per set; rows of empty sets are zero."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    with np.errstate(over="ignore"):
        for band in range(bands):
            mixed = np.full(len(full), band, np.uint64)
            for k in range(band * rows, band * rows + rows):
                least = np.minimum.reduceat(values * factors[k] + shifts[k], bounds[full])
                mixed = (mixed ^ least) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
            out[full, band] = mixed
    return out


def _entries(docs: DataFrame, bands: int, rows: int, n_words: int) -> DataFrame:
    """Per document: id, key of its n-gram set (null without words), size, band hashes."""
    schema = T.StructType([T.StructField("__id", id_type(docs, "__id")), *T._parse_datatype_string("entry binary, size long, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, bounds = ngram_sets(batch.column(1), n_words)
            sizes = np.diff(bounds)
            hashes = band_hashes(values, bounds, bands, rows).view(np.int64)
            keys = [hashlib.md5(values[a:b].tobytes()).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes), lists], names=["__id", "entry", "size", "bands"])

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, n_words: int) -> DataFrame:
    """Key and n-grams of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, bounds = ngram_sets(batch.column(1), n_words)
            full = np.flatnonzero(np.diff(bounds))
            keys = [hashlib.md5(values[bounds[i] : bounds[i + 1]].tobytes()).digest() for i in full.tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.append(bounds[full], bounds[-1]).astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], names=["entry", "grams"])

    return docs.mapInArrow(run, "entry binary, grams array<long>")


def shared_counts(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Matrix of the number of values that two sets share."""
    out = np.zeros((n, n), np.int64)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    runs = np.diff(np.append(first, len(values)))
    group = np.repeat(np.arange(len(first)), runs)
    common = runs[group] > _COMMON
    rare_owner, rare_group = owner[~common], group[~common]
    for step in range(1, _COMMON):
        same = np.flatnonzero(rare_group[step:] == rare_group[:-step])
        if not len(same):
            break
        a, b = rare_owner[same], rare_owner[same + step]
        out += np.bincount(a * n + b, minlength=n * n).reshape(n, n)
    if common.any():
        column = np.unique(group[common], return_inverse=True)[1]
        rows = owner[common]
        for start in range(0, int(column.max()) + 1, 4096):
            part = (column >= start) & (column < start + 4096)
            dense = np.zeros((n, 4096), np.float32)
            dense[rows[part], column[part] - start] = 1
            out += np.triu(dense @ dense.T, 1).astype(np.int64)
    return out + out.T


def _compare(keys: list[bytes], counts: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], cross: bool, threshold: float):
    """Links of one unit: weighted and plain sums per entry, and the entry each is first linked to."""
    n = len(keys)
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = shared_counts(np.repeat(np.arange(n), sizes), np.concatenate(sets), n)
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if cross:
        linked &= blocks[:, None] != blocks[None, :]
    texts, docs = linked.sum(1), linked @ counts
    # A spanning set of links: each entry of a connected part points to the part's first entry.
    head = np.full(n, -1)
    for i in range(n):
        if head[i] >= 0 or not texts[i]:
            continue
        head[i], open_nodes = i, [i]
        while open_nodes:
            near = np.flatnonzero(linked[open_nodes.pop()] & (head < 0))
            head[near] = i
            open_nodes += near.tolist()
    return texts, docs, head


def _units(rows: DataFrame, threshold: float) -> DataFrame:
    """Compare the entries of each unit. Rows arrive sorted by unit and may be cut anywhere into batches."""

    def flush(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(part)
        keys, lists = table["entry"].to_pylist(), table["grams"].combine_chunks()
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        cross = table["p"][0].as_py() != table["q"][0].as_py()
        texts, docs, head = _compare(keys, table["copies"].to_numpy(), table["block"].to_numpy(), sets, cross, threshold)
        found = np.flatnonzero(texts)
        return pa.RecordBatch.from_pydict(
            {
                "entry": pa.array([keys[i] for i in found], pa.binary()),
                "texts": pa.array(texts[found], pa.int64()),
                "docs": pa.array(docs[found], pa.int64()),
                "other": pa.array([keys[head[i]] for i in found], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = [], None
        for batch in batches:
            roots, p, q = (batch.column(batch.schema.get_field_index(c)) for c in ("root", "p", "q"))
            units = list(zip(roots.to_pylist(), p.to_pylist(), q.to_pylist()))
            cuts = [0, *[i for i in range(1, len(units)) if units[i] != units[i - 1]], len(units)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and units[a] != unit:
                    yield flush(held)
                    held = []
                unit = units[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "entry binary, texts long, docs long, other binary")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n_words: int = N_WORDS,
    recall: float = RECALL, max_hashes: int = MAX_HASHES, block_sets: int = BLOCK_SETS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row per document: ``id_col, class_id, n_links, n_linked_texts, class_size``.

    Two documents are linked if the Jaccard similarity of their word n-gram sets is at least ``threshold``. ``n_links``:
    linked documents, copies included; ``n_linked_texts``: linked different sets; ``class_id``: smallest identifier
    reachable over links; ``class_size``: documents of the class. Null, empty and wordless texts are linked to nothing
    and are classes of their own. Repeated rows count as copies. Null identifiers pass through, and a class of null
    identifiers has a null ``class_id``. An empty table gives an empty result; other columns are not read.

    A pair at the threshold is a candidate with probability ``recall`` at least, more similar ones more surely, and also
    if it is only connected through other candidates.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    texts = ids_and_texts(docs, id_col, text_col)
    by_doc = materialize(_entries(texts, bands, rows, n_words), "entries")
    entries = (
        by_doc.where(F.col("entry").isNotNull())
        .groupBy("entry")
        .agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    )
    entries = materialize(entries, "entries")
    buckets = entries.select("entry", F.posexplode("bands").alias("band", "hash"))
    heads = materialize(
        buckets.groupBy("band", "hash").agg(F.min("entry").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "heads"
    )
    links = buckets.join(heads, ["band", "hash"]).select(F.col("entry").alias("a"), F.col("head").alias("b")).distinct()
    groups = connected(links).select(F.col("node").alias("entry"), "root")
    members = materialize(groups.join(entries.select("entry", "least", "copies", "size"), "entry"), "members")
    blocks = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("size") / block_items)).cast("int").alias("blocks")
    )
    # The sets of candidates, from one document each. A null identifier finds all rows without one; equal keys collapse.
    source = members.select(F.col("least").alias("__least")).distinct()
    chosen = texts.join(source, F.col("__id").eqNullSafe(F.col("__least")), "left_semi").select("__id", "__text")
    sets = _sets(chosen, n_words).dropDuplicates(["entry"])
    placed = (
        salted_lookup(members, "root", blocks, "entry")
        .withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
        .join(sets, "entry")
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "root", F.least("block", "other_block").alias("p"), F.greatest("block", "other_block").alias("q"), "block", "entry", "copies", "grams"
        )
        .repartition("root", "p", "q")
        .sortWithinPartitions("root", "p", "q", "entry")
    )
    verified = materialize(_units(placed, threshold), "verified")
    sums = verified.groupBy("entry").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = connected(verified.select(F.col("entry").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "entry")
    known = (
        entries.select("entry", "least", "copies").join(classes, "entry", "left").join(sums, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    )
    known = materialize(known, "classes")
    whole = known.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    values = salted_lookup(known, "root", whole, "entry").select(
        "entry",
        "class_id",
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        "class_size",
    )
    with_words = salted_lookup(by_doc.where(F.col("entry").isNotNull()).select("__id", "entry"), "entry", values, "__id").drop("entry")
    zero = F.lit(0).cast("long")
    alone = by_doc.where(F.col("entry").isNull()).select(
        "__id", F.col("__id").alias("class_id"), zero.alias("n_links"), zero.alias("n_linked_texts"), F.lit(1).cast("long").alias("class_size")
    )
    return with_words.unionByName(alone).withColumnRenamed("__id", id_col)


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **join) -> DataFrame:
    """One document of every class of near-duplicates, with all its columns: that of the smallest identifier.

    Documents are told apart by identifier and text. Rows that repeat both are one document and stay together. Null, empty
    and wordless texts are classes of their own and stay; a null identifier stays only where no document of the class has
    one. An empty table gives an empty one.
    """
    text = F.col(f"`{text_col}`").cast("string")
    row = F.struct(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text"))
    classes = jaccard_classes(docs.select(row.alias("__row"), text.alias("__whole")), "__row", "__whole", **join)
    kept = classes.where(F.col("__row").eqNullSafe(F.col("class_id"))).select(F.col("__row.id").alias("__keep"), F.col("__row.text").alias("__key")).distinct()
    own = F.coalesce(F.xxhash64(docs[f"`{text_col}`"].cast("string")), F.lit(0))
    same = docs[f"`{id_col}`"].eqNullSafe(kept["__keep"]) & (own == kept["__key"])
    return docs.join(kept, same, "left_semi")
