"""Spelling variants: words of a corpus grouped under the frequent word that is one edit away.

Words one code point apart agree in front of the edit and behind it. With ``c`` the length of the shorter one, they share
their first c / 2 code points or their last c - c / 2, so every word joins one group by its front and one by its back, as
the shorter and as the longer of a pair. Inside a group, words are sorted (by their reverse where the back is shared) and
scanned by ``spelling_scan``. A group of more words than one scan takes is divided the same way again, by halves of what
is not yet shared, until a group only differs in one place; that is a bounded number of words. Groups by the back count a
pair only if it does not meet by the front, so that no pair is found twice.

Only the best neighbour and the number of neighbours of each word leave a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import prepare
from briefloom.llm.spelling_scan import code_points, pairs
from briefloom.operators.graph import salted_lookup
from briefloom.session import materialize, parallelism

GROUP_WORDS = 1 << 15  # words of one scan at most, as long as a group can be divided
_CHUNK_CHARS = 1 << 21  # code points scanned in step
_ANYWHERE = 1 << 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def run_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, typo_every: int | None = None) -> DataFrame:
    """``word, n``: runs of letters (ASCII and U+00C0 to U+00FF, A-Z in lower case) and their occurrences in whole texts.

    ``typo_every``: where this divides h, the unsigned CRC-32 of the UTF-8 of ``<id>:<run>``, the run's code point
    h % length, counted from 0, is left out: typing errors at a known rate. Words of fewer than ``min_length`` code
    points or ``min_count`` occurrences are left out. Null texts have no words; a null identifier is written as nothing.
    """
    low = F.translate(F.col(f"`{text_col}`").cast("string"), _UPPER, _LOWER)
    run = F.col("run")
    runs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.filter(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0)), lambda r: F.length(r) >= min_length)).alias("run"),
    )
    if typo_every:
        h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
        runs = runs.select(F.when(h % typo_every == 0, cut).otherwise(run).alias("run")).where(F.length("run") >= min_length)
    return runs.groupBy(run.alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _grouped(rows: DataFrame, c: Column, front: Column, back: Column, below: Column) -> DataFrame:
    """``rows`` (word, n) in the group of words that share ``front`` and ``back`` code points, shorter length ``c``.

    ``below``: only pairs that share fewer code points in front belong to the group.
    """
    word = F.col("word")
    shared = [word.substr(F.lit(1), front), F.when(back > 0, word.substr(F.length(word) - back + 1, back)).otherwise("")]
    key = F.concat_ws("/", c, front, back, below, *shared)
    return rows.select("word", "n", c.alias("c"), front.alias("front"), back.alias("back"), below.alias("below"), key.alias("key"))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row once by the first half of what its group does not share yet, and once by the second half."""
    c, front, back, below = (F.col(x) for x in ("c", "front", "back", "below"))
    half = F.floor((c - front - back) / 2).cast("int")
    by_front = F.struct((front + half).alias("front"), back.alias("back"), below.alias("below"))
    by_back = F.struct(front.alias("front"), (c - front - half).alias("back"), F.least(below, front + half).alias("below"))
    wide = rows.select("word", "n", "c", F.inline(F.array(by_front, by_back)))
    return _grouped(wide, F.col("c"), F.col("front"), F.col("back"), F.col("below"))


def _groups(words: DataFrame, group_words: int) -> DataFrame:
    """Every word in its groups: word, c, front, back, below, key."""
    size = F.length("word")
    roles = words.select(
        "word", "n", F.explode(F.array(size, size - 1)).alias("c"), F.lit(0).alias("front"), F.lit(0).alias("back"), F.lit(_ANYWHERE).alias("below")
    )
    level = materialize(_halves(roles.where("c > 0")), "groups")
    ready = None
    while True:
        large = level.where("c - front - back > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group_words)
        large = materialize(large.select("key", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            return level if ready is None else ready.unionByName(level)
        marked = materialize(salted_lookup(level, "key", large, "word", how="left"), "groups")
        small = marked.where("large is null").drop("large")
        ready = small if ready is None else ready.unionByName(small)
        level = materialize(_halves(marked.where("large")), "groups")


def _front_shared(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _scan(words: list[str], counts: np.ndarray, keys: list[str]) -> tuple[list[str], list[int], list[int], list[str]]:
    """Neighbours of the words of whole groups: word, number of them, the largest count and its word."""
    none: tuple = ([], [], [], [])
    facts: dict[str, tuple[int, int, bool]] = {}
    group = np.zeros(len(keys), np.int64)
    for i, key in enumerate(keys):
        if key not in facts:
            c, front, back, below = map(int, key.split("/", 4)[:4])
            facts[key] = c, below, back > front
        group[i] = len(facts) - 1  # rows of a group stand together
    shorter, below, turned = (np.array(x)[group] for x in zip(*facts.values()))
    lists = [w[::-1] if t else w for w, t in zip(words, turned.tolist())]
    first, second = pairs(*code_points(lists), group)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    longer = np.maximum(sizes[first], sizes[second])
    least = np.minimum(sizes[first], sizes[second])
    kept = (least == shorter[first]) & (longer <= least + 1)
    tested = np.flatnonzero(kept & (below[first] < _ANYWHERE))
    for k in tested.tolist():
        kept[k] = _front_shared(words[first[k]], words[second[k]]) < below[first[k]]
    first, second = first[kept], second[kept]
    if not len(first):
        return none
    one, other = np.concatenate([first, second]), np.concatenate([second, first])
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[other], -counts[other], one))
    one, other = one[order], other[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(one) != 0]))
    n_near = np.diff(np.append(starts, len(one)))
    best = other[starts]
    return [words[i] for i in one[starts].tolist()], n_near.tolist(), counts[best].tolist(), [words[i] for i in best.tolist()]


def neighbours(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, n_near, near_n, near``: of every word with neighbours one edit away, how many, and the most frequent one.

    ``words``: ``word, n``, no word twice. Of equally frequent neighbours the first in code-point order.
    """
    prepare(words.sparkSession)
    turned = F.when(F.col("back") > F.col("front"), F.reverse("word")).otherwise(F.col("word"))
    rows = _groups(words, group_words).select("key", "word", "n", turned.alias("listed"))
    lists = rows.repartition(parallelism(words), "key").sortWithinPartitions("key", "listed").select("key", "word", "n")
    schema = "word string, n_near long, near_n long, near string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        words: list[str] = []
        counts: list[int] = []
        held = 0

        def found(n: int) -> pa.RecordBatch:
            got = _scan(words[:n], np.array(counts[:n], np.int64), keys[:n])
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, types)], names=["word", "n_near", "near_n", "near"])

        for batch in batches:
            for key, word, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held >= _CHUNK_CHARS and key != keys[-1]:
                    yield found(len(words))
                    keys, words, counts, held = [], [], [], 0
                keys.append(key)
                words.append(word)
                counts.append(n)
                held += len(word)
        if words:
            yield found(len(words))

    partial = lists.mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near")
    )


def variant_groups(words: DataFrame, ratio: int = 5, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words`` (``word, n``, no word twice).

    ``n_near``: words exactly one inserted, deleted or replaced code point away. ``form``: the most frequent of them (of
    equally frequent ones the first in code-point order), if it is at least ``ratio`` times as frequent, else null;
    ``form_n`` its count. ``root``: where following forms ends, the word itself without a form. Null and empty words are
    left out; an empty table gives an empty one; other columns are not read.
    """
    words = materialize(words.where("word != ''").select("word", "n"), "words")
    near = neighbours(words, group_words)
    joined = words.join(near, "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    linked = materialize(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    # Counts grow along the forms, so the chains end, and each round doubles what has been followed.
    state = linked.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        up = state.select(F.col("word").alias("root"), F.col("root").alias("above"))
        climbed = salted_lookup(state.select("word", "root"), "root", up, "word", how="left")
        state = materialize(climbed.select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            break
    rooted = linked.join(state.select("word", "root"), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
