"""Spelling variants: the scan and the whole operator against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from briefloom.llm.queries import QUERIES
from briefloom.llm.spelling import neighbours, run_counts, variant_groups
from briefloom.llm.spelling_scan import code_points, common_prefixes, next_shorter, pairs

SCHEMA = "doc_id long, text string, word string, n string, run string, key int, id string"
EXTRA = ("w", "x", "y", 2, "z")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def counted(docs, min_length=6, min_count=5, typo_every=199):
    """The words of (id, text) rows, by the contract's own text."""
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo_every and h % typo_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= min_length:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= min_count}


def brute(words, ratio=5):
    """word: (form, root, n, n_near, form_n), by deleting one code point at every place."""
    holes = {}
    for w in words:
        for i in range(len(w) + 1):
            holes.setdefault((w[:i], w[i:]), set()).add(w)  # something is inserted here
            if i < len(w):
                holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)  # something stands here
    close = {w: set() for w in words}
    for group in holes.values():
        for w in group:
            close[w] |= {v for v in group if v != w}
    out = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form, w, n, len(close[w]), None if form is None else words[form]]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_brute_force_is_all_pairs():
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))): rng.randrange(5, 99) for _ in range(60)}
    assert {w: v[3] for w, v in brute(words).items()} == {w: sum(near(w, v) for v in words) for w in words}


def test_scan_finds_all_pairs():
    rng = random.Random(4)
    for _ in range(200):
        letters, words, group = rng.choice(["a", "ab", "abc", "abcdé"]), [], []
        for k in range(rng.randint(1, 4)):
            own = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 50))})
            words += own
            group += [k] * len(own)
        first, second = pairs(*code_points(words), np.array(group))
        want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if group[i] == group[j] and near(words[i], words[j])]
        assert sorted(zip(first.tolist(), second.tolist())) == want


def test_prefixes_and_pointers():
    words = ["", "a", "ab", "abc", "abd", "b", "bc"]
    lcp = common_prefixes(*code_points(words))
    assert lcp.tolist() == [0, 0, 1, 2, 2, 0, 1]
    assert next_shorter(lcp).tolist() == [7, 7, 5, 5, 5, 7, 7]


def test_words_of_documents(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["Readingly", "readingly", "ÉCOLESÀÿ", "x" * 300, "short", "d'apresnous", "naïveté9naïveté", "日本readingly"]) for _ in range(200))) for i in range(40)]
    texts += [(None, "readingly " * 9), (1, None), (2, ""), (7, texts[7][1])]
    docs = spark.createDataFrame([(i, t, *EXTRA) for i, t in texts], SCHEMA).repartition(3)
    got = {r.word: r.n for r in run_counts(docs, typo_every=199).collect()}
    assert got == counted(texts) and any("readingl" == w or len(w) == 8 for w in got)
    assert {r.word: r.n for r in run_counts(docs, min_length=2, min_count=1).collect()} == counted(texts, 2, 1, None)


@pytest.mark.parametrize("group_words", [1, 3, 1 << 15])
def test_groups_equal_brute_force(spark, group_words):
    """Small groups are divided again and again; the result stays the same."""
    rng = random.Random(7)
    words = {"".join(rng.choice(["a", "b", "é"]) for _ in range(rng.randrange(1, 9))): rng.choice([5, 5, 25, 30, 125, 700]) for _ in range(500)}
    words |= {"x" * 40: 5, "x" * 41: 25, "x" * 42: 125, "common" + "y" * 6: 9}
    words |= {"common" + "".join(rng.choice("pqrs") for _ in range(6)): rng.randrange(5, 200) for _ in range(300)}
    table = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, near int")
    assert result(variant_groups(table, group_words=group_words)) == brute(words)


def test_chains_ties_nulls_and_empty_tables(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 625, "abcgggg": 625, "zzzzzz": 5, "zzzzzy": 24, "tttttt": 5, "tttttb": 50, "tttttc": 50}
    table = spark.createDataFrame([*words.items(), (None, 9), ("", 9)], "word string, n long")
    got = result(variant_groups(table))
    assert got == brute(words)
    assert got["abcdef"] == ("abcdeg", "abcggg", 5, 1, 25) and got["tttttt"][0] == "tttttb" and got["zzzzzz"][0] is None
    nothing = spark.createDataFrame([], "word string, n long")
    assert variant_groups(nothing).collect() == [] and neighbours(nothing).collect() == []
    assert run_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(counted(docs))
    assert result(QUERIES["op12_spelling_variants"](spark, sf)) == want
    assert any(v[0] for v in want.values())
