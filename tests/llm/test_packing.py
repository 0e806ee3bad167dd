"""Packing: every id in exactly one piece, sequences without gaps, next to no padding, the plan's own arithmetic."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from briefloom.llm import packing_plan
from briefloom.llm.byte_bpe import encoder
from briefloom.llm.packing import pack
from briefloom.llm.packing_plan import combinations, make_plan, repeat_counts
from briefloom.llm.queries import QUERIES, vocabulary

PATH = vocabulary("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, __id string, __text long, __task string, __row int, ids string, length int"
EXTRA = ("x", 1, "y", 2, "z", 3)
WINDOW = 64


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(pieces, texts, window):
    """Check pieces against the library; texts: list of (id, text) with unique ids. Returns padded tokens."""
    encode = library()
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_doc[p.doc_id].append(p)
        per_sequence[p.sequence_id].append(p)
    assert set(per_doc) == {i for i, _ in texts}
    for i, text in texts:
        want = [*encode.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(per_doc[i], key=lambda p: p.start)
        assert [p.start for p in got] == np.cumsum([0, *[p.length for p in got]])[:-1].tolist()
        assert all(p.doc_tokens == len(want) and len(p.ids) == 4 * p.length for p in got)
        assert np.frombuffer(b"".join(p.ids for p in got), "<u4").tolist() == want
    for held in per_sequence.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == np.cumsum([0, *[p.length for p in held]])[:-1].tolist()
        assert sum(p.length for p in held) <= window
    assert set(per_sequence) == set(range(len(per_sequence)))
    return len(per_sequence) * window - sum(p.length for p in pieces)


def test_every_id_in_one_piece(spark):
    rng = random.Random(3)
    texts = [(1, None), (2, ""), (3, "a b c"), (4, "<|endoftext|> é日本 <|endoftext|>"), (5, "zz" * 900), (6, " " * 500)]
    texts += [(i, " ".join(rng.choice(["red", "tokens", "été", "x1"]) for _ in range(rng.randrange(90)))) for i in range(7, 200)]
    texts += [(i, "the same text again and again") for i in range(200, 400)]
    docs = spark.createDataFrame([(i, t, *EXTRA) for i, t in texts], SCHEMA).repartition(5)
    assert whole(pack(docs, PATH, window=WINDOW).collect(), texts, WINDOW) < WINDOW


def test_repeated_rows_null_identifiers_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", *EXTRA), (1, "a", *EXTRA), (None, "a", *EXTRA)], SCHEMA)
    got = pack(docs, PATH, window=8).collect()
    assert sorted((p.doc_id or 0, p.length) for p in got) == [(0, 2), (1, 2), (1, 2)]
    assert sorted(p.offset for p in got) == [0, 2, 4] and {p.sequence_id for p in got} == {0}
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_documents_of_full_windows(spark):
    docs = spark.createDataFrame([(i, "a" + " a" * (15 + i), *EXTRA) for i in range(17)], SCHEMA)
    got = pack(docs, PATH, window=16).collect()
    assert whole(got, [(r.doc_id, r.text) for r in docs.collect()], 16) < 16
    assert sum(p.length == 16 for p in got) >= 17  # full windows stay whole


def test_encoder_equals_the_library():
    encode, lib, rng = encoder(PATH), library(), random.Random(5)
    odd = ["<|endoftext|>", "'ll", "'S", " ", "  ", "\n", "\t", "\x1c", "\x85", "½", "²", "٣", "字", "é", "A", "z", "1", ".", "'", "🙂", "‍"]
    for _ in range(4_000):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(24)))
        assert np.frombuffer(encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_to_their_library():
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path).encode("Some words, été!", add_special_tokens=False).ids
    assert np.frombuffer(encoder(path)("Some words, été!"), "<u4").tolist() == want


def filled(plan, counts, window):
    """Tokens per window, after checking that every rest is covered once."""
    fill = np.zeros(plan.n_windows, np.int64)
    for _, _, count, _, size, sequence, offset in plan.rows.tolist():
        assert (fill[sequence : sequence + count] == offset).all()
        fill[sequence : sequence + count] += size
    for length in np.flatnonzero(counts):
        covered = np.zeros((counts[length], length), np.int64)
        for _, first, count, start, size, _, _ in plan.rows[plan.rows[:, 0] == length].tolist():
            covered[first : first + count, start : start + size] += 1
        assert (covered == 1).all()
    return fill


@pytest.mark.parametrize("shape", ["any", "short", "one", "long", "two", "none"])
def test_plan_covers_every_rest_once(shape):
    rng, window = np.random.default_rng(8), 128
    lengths = {
        "any": rng.integers(1, window, 4_000), "short": rng.integers(1, 9, 500), "one": np.full(777, 90), "long": rng.integers(65, window, 900),
        "two": np.repeat([28, 50], 600), "none": np.zeros(0, np.int64),
    }[shape]
    counts = np.bincount(lengths, minlength=window)
    plan = make_plan(counts, window)
    fill = filled(plan, counts, window)
    assert (fill > 0).all() and len(fill) == -(-lengths.sum() // window)
    if shape == "any":
        assert plan.n_solved > 0.8 * plan.n_windows
    if shape == "two":  # 28 + 50 + 50 fills a window of 128
        assert plan.n_solved == 300 and (fill[:300] == window).all()


def test_plan_of_many_documents_repeats(monkeypatch):
    monkeypatch.setattr(packing_plan, "_AT_ONCE", 500)
    rng, window = np.random.default_rng(9), 32
    counts = np.bincount(rng.integers(1, window, 9_000), minlength=window)
    fill = filled(make_plan(counts, window), counts, window)
    assert (fill < window).sum() < 0.02 * len(fill)


def test_least_squares_conditions():
    """At the solution no column has a gradient that would pull it up, and used columns have none that pulls them down."""
    rng, window = np.random.default_rng(10), 40
    counts = np.bincount(rng.integers(1, window, 5_000), minlength=window)
    columns = combinations(counts, window)
    assert {tuple(c) for c in columns.tolist()} == {
        (a, b, window - a - b) for a in range(window) for b in range(max(a, 1), window) if b <= window - a - b < window and (a == 0 or counts[a])
    }
    chosen, x = repeat_counts(columns, counts)
    made = np.zeros(window + 1)
    for c, n in zip(columns[chosen].tolist(), x):
        for length in c:
            made[length] += n
    gradient = [sum((made[n] - counts[n]) for n in c if n) for c in columns.tolist()]
    assert min(gradient) > -1 and max(np.array(gradient)[chosen[x > 1]]) < 5


def test_query(spark, sf):
    got = QUERIES["op11_packing"](spark, sf).collect()
    encode = encoder(PATH)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fill = defaultdict(int)
    for p in got:
        ids = encode(text[p.doc_id] or "") + np.array([1], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) and p.doc_tokens == len(ids) // 4
        fill[p.sequence_id] += p.length
    assert sum(fill.values()) == sum(len(encode(t or "")) // 4 + 1 for t in text.values())
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)
