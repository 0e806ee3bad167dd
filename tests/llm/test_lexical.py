"""Lexical search: the best position algorithm against whole sums, the operator against scores computed one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from briefloom.llm.best_position import Shard
from briefloom.llm.lexical import _scaled, search, terms_of, weights

DOCS = "doc_id long, text string, term string, __id string, __item int, score int, rank int, n long"
EXTRA = ("x", "y", 1, 2, 3, 4)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def ranked(docs, items, k):
    """(item, rank, doc, score) of every item, by the sums of all documents."""
    found = [(i, words(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in found:
            tf = Counter(w)
            m = 75 + (25 * len(w) * n_docs) // total if w else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if tf[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def table(df, doc="doc_id"):
    return sorted(((r.item_id, r["rank"], r[doc], r.score) for r in df.collect()), key=repr)


def test_terms():
    text = "It's Été_3x -- DÉJÀ 日本語\x00\x7fÀB c 12.5 \U0001f642ok"
    assert [t.decode() for t in terms_of(text)] == words(text) and terms_of(None) == terms_of("... ") == []


@pytest.mark.parametrize("shard_postings", [1, 40, 1 << 21])
def test_search_equals_whole_sums(spark, shard_postings):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "été", "x1", "日本"] * 9 + [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(200 + i, "the same text for all") for i in range(40)] + [(300, None), (301, ""), (302, "..."), (303, "the " * 3_000), (None, "w1 the"), (None, None)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for j in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere else"), (93, "the same text for all"), (94, "w1 w1 w1 the"), (None, "w2 the")]
    left = spark.createDataFrame([(*d, *EXTRA) for d in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    assert table(search(left, right, k=7, shard_postings=shard_postings)) == ranked(docs, items, 7)


def test_blocks_of_items_give_the_same(spark):
    docs = [(i, f"alpha beta{i % 4} gamma{i % 9}") for i in range(60)]
    items = [(j, f"alpha gamma{j}") for j in range(9)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert table(search(left, right, k=5, block_bytes=200)) == ranked(docs, items, 5)


def test_string_identifiers_of_one_name_repeated_rows_and_empty_tables(spark):
    left = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "id string, text string")
    right = spark.createDataFrame([("q", "two"), ("q", "two")], "id string, text string")
    got = [(r.id, r["rank"], r.doc_id) for r in search(left, right, id_col="id", item_col="id").collect()]
    assert sorted(got, key=repr) == sorted([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("q", 4, None)] * 2, key=repr)
    nothing = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert search(nothing, items).collect() == [] and search(left, items.limit(0), id_col="id").collect() == []


def test_best_positions_stop_early_and_exactly():
    rng = np.random.default_rng(5)
    n_docs, n_terms = 3_000, 12
    looked_up = []
    for case in range(30):
        terms, docs = np.nonzero(rng.random((n_terms, n_docs)) < rng.choice([0.02, 0.3, 0.9], (n_terms, 1)))
        impacts = rng.integers(1, 6 if case % 2 else 10**9, len(terms))
        if case % 3 == 0:
            impacts = impacts**2 // 10**6 + 1
        shard = Shard(terms, docs, impacts, n_terms + 1, n_docs)
        query = rng.choice(n_terms + 1, 4, replace=False)  # the last term has no postings
        repeats = rng.integers(1, 3, 4)
        total = np.zeros(n_docs, np.int64)
        for t, r in zip(query, repeats):
            np.add.at(total, docs[terms == t], r * impacts[terms == t])
        for k, least in ((20, 1), (1, 1), (20, int(np.sort(total)[-5])), (n_docs, 1)):
            got_docs, got, met = shard.search(query, repeats, k, least)
            cut = max(least, 1, int(np.sort(total)[-k]))
            assert sorted(zip(got_docs.tolist(), got.tolist())) == [(d, int(total[d])) for d in np.flatnonzero(total >= cut)]
            assert not shard._seen.any() and not shard._met.any()
            if k == 20:
                looked_up.append(met)
    assert min(looked_up) < n_docs / 10


def test_direct_accesses_move_the_best_position():
    """The list of term 1 is read to its third document only, but all of it is seen through the other list."""
    docs = np.arange(40)
    shard = Shard(np.repeat([0, 1], 40), np.concatenate([docs, docs]), np.concatenate([1000 - docs, 500 - docs]), 2, 40)
    _, _, met = shard.search(np.array([0, 1]), np.array([1, 1]), 3)
    assert met == 16


def test_whole_numbers():
    assert weights(np.array([0, 1, 9, 10]), 10).tolist() == [math.floor(1000 * math.log(22 / (2 * df + 1))) for df in (0, 1, 9, 10)]
    x = np.array([3, 10**15, 7], np.int64)
    assert _scaled(x, 10**10, 10**12).tolist() == [int(v) * 10**10 // 10**12 for v in x.tolist()]
