"""Steps that must not repeat their work as tables grow."""

from __future__ import annotations

import random
from datetime import date, timedelta
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.operators import pairs, ranges
from briefloom.streaming.cache_state import _Cache
from briefloom.workload import report_queries


def test_a_held_key_keeps_its_timer():
    fields = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])
    calls, held = [], {}
    handle = SimpleNamespace(
        registerTimer=lambda t: calls.append(("set", t)), deleteTimer=lambda t: calls.append(("delete", t)),
        getValueState=lambda name, schema: SimpleNamespace(
            exists=lambda: "v" in held, get=lambda: held.get("v"), update=lambda v: held.update(v=v), clear=held.clear
        ),
    )
    cache = _Cache("at", "n", int(timedelta(seconds=10) / timedelta(milliseconds=1)), fields)
    cache.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    fired = lambda ms: SimpleNamespace(getExpiryTimeInMs=lambda: ms)
    row = Row("k", "at", "n")
    for second, n in ((1, 1), (5, 2), (3, 3)):
        [*cache.handleInputRows(("a",), iter([row("a", second * 1_000_000, n)]), at(0))]
    assert calls == [("set", 11_000)] and held["v"] == ("a", 5_000_000, 2)
    assert not [*cache.handleExpiredTimer(("a",), at(12_000), fired(11_000))] and calls[1:] == [("set", 15_000)]
    [gone] = cache.handleExpiredTimer(("a",), at(15_000), fired(15_000))
    assert gone.expired and gone.n == 2 and not held
    assert not [*cache.handleExpiredTimer(("a",), at(16_000), fired(15_000))]


def test_a_batch_of_events_may_have_several_files(spark, sf, monkeypatch):
    monkeypatch.setattr(report_queries, "FILE_EVENTS", 100)
    paths = []
    new_path = report_queries.new_path
    monkeypatch.setattr(report_queries, "new_path", lambda s, label: paths.append(new_path(s, label)) or paths[-1])
    got = {(r.content_hash, r.event_id) for r in report_queries.stream_expiry(spark, sf).collect()}
    files = spark.read.parquet(next(p for p in paths if "event-files" in p)).select(F.input_file_name()).distinct().count()
    monkeypatch.setattr(report_queries, "FILE_EVENTS", 10**9)
    assert files > 4 and files % 4 == 0
    assert got == {(r.content_hash, r.event_id) for r in report_queries.stream_expiry(spark, sf).collect()}


ITEMS = "ord bigint, date date, id string, content_hash string, canonical_url string, source_tier int, impact_score int"


def test_linking_of_stories_sees_keys_and_not_items(spark, monkeypatch):
    links = []
    connected = ranges.connected
    monkeypatch.setattr(ranges, "connected", lambda df: links.append(df.count()) or connected(df))
    day = date(2026, 7, 1)
    # 300 items with three fingerprints; each URL comes twice, and one of them ties the first two fingerprints.
    rows = [(i, day + timedelta(i % 3), f"i{i}", f"h{i % 3}", f"u{i // 6}-{i % 3}", 2, 1) for i in range(300)] + [(300, day, "x", "h1", "u0-0", 1, 1)]
    got = ranges.merge_items(spark.createDataFrame(rows, ITEMS), closure=True).collect()
    assert links == [1]
    assert {(r.first_ord, r.ord, len(r.report_dates)) for r in got} == {(0, 300, 2), (2, 2, 1)}


def test_stories_of_odd_items_are_those_of_their_groups(spark):
    rng = random.Random(5)
    pick = lambda name, n: rng.choice([None, "", name]) if rng.random() < 0.3 else f"{name}{rng.randrange(n)}"
    pick_order = lambda: rng.choice([None, *range(1500)])
    rows = [
        # Repeated and missing orders, missing and empty keys, repeated rows.
        (pick_order(), date(2026, 7, rng.randint(1, 5)), pick("i", 200), pick("h", 250), pick("u", 250), rng.choice([None, 0, 1, 2]), rng.randint(-3, 3))
        for _ in range(200)
    ]
    items = spark.createDataFrame(rows + rows[:20], ITEMS)
    groups = {}
    for r in items.join(ranges.merge_groups(items), "ord").collect():
        groups.setdefault(r.first_ord, []).append((r.source_tier or 9, -abs(r.impact_score), r.ord, r.date))
    want = {(first, min(g)[2], tuple(sorted({d for *_, d in g}, reverse=True))) for first, g in groups.items()}
    got = ranges.merge_items(items, closure=True).collect()
    assert len(want) > 5 and {(r.first_ord, r.ord, tuple(r.report_dates)) for r in got} == want
    assert len(got) == sum(r[0] in {w[1] for w in want} for r in rows + rows[:20])


def test_a_set_travels_once_to_all_its_candidates_of_two_blocks(spark, monkeypatch):
    def seen():
        def count(asked: pa.Table, held: pa.Table) -> pa.Table:
            rows = [held.num_rows] * asked.num_rows
            return pa.table({**{c: asked.column(c) for c in ("fam", "x", "y")}, "shared": [1] * len(rows), "nx": rows, "ny": rows})

        return count

    monkeypatch.setattr(pairs, "_counting", seen)
    sets = spark.createDataFrame([(0, i, list(range(i, i + 50))) for i in range(40)], "fam int, sid bigint, set array<bigint>")
    asked = spark.createDataFrame([(0, x, y, 7) for x in range(40) for y in range(x)], "fam int, x bigint, y bigint, meet bigint")
    got = {r.similarity for r in pairs.checked_sets(asked, sets, {0: 0.0}).collect()}
    assert got == {1 / (40 + 40 - 1)}


def test_the_exact_check_in_parts_finds_what_all_pairs_give(spark, monkeypatch):
    for name, value in (("BATCH_PAIRS", 5), ("PART_PAIRS", 10), ("BLOCK_ROWS", 8), ("CHECK_ROWS", 3), ("WORD_SHINGLES", 2)):
        monkeypatch.setattr(pairs, name, value)
    rng = random.Random(3)
    base = [frozenset(rng.sample(range(400), rng.choice([5, 30, 90]))) for _ in range(6)]
    rows = [(i, sorted(rng.choice(base) - {rng.randrange(400) for _ in range(rng.randrange(60))})) for i in range(70)]
    rows += rows[:3]  # a key that comes twice, with its set
    df = spark.createDataFrame(rows, "ord bigint, set array<bigint>")
    got = pairs.similar_pairs(df, "ord", F.col("set").cast("array<string>"), 0.6).where("similarity < 1").collect()
    by_key = {}
    for key, members in rows:
        by_key.setdefault(frozenset(members), key)
    want = {
        (min(a, b), max(a, b)): len(s & t) / len(s | t)
        for s, a in by_key.items() for t, b in by_key.items() if s and t and a < b and len(s & t) / len(s | t) >= 0.6
    }
    assert len(want) > 30 and {(r.a, r.b): r.similarity for r in got} == want
