"""Rule behaviour, parity with brute force, and end-to-end invariants."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
import reference_clustering as brute
from pyspark.sql import functions as F

from briefloom.lexicons import VEHICLE_CARE_LEXICON, VEHICLE_CARE_RULES
from briefloom.operators import dedup, lexicon, pairs, quality, queries, ranges, robots, signals, store
from briefloom.plans.briefing import briefing
from briefloom.plans.daily import collect_preview, collect_funnel, index_entry, run_daily
from briefloom.schemas import RAW_ITEM
from briefloom.workload import item_queries, source_queries
from briefloom.workload.inputs import dedup_items

NOW = datetime(2026, 7, 21, 12)


def now():
    return F.lit("2026-07-21T12:00:00Z").cast("timestamp")


def raw(ord, title, link, snippet="", hours=6, tier=2, country="TH", lang="en", source="press", unverified=False, kind="news"):
    ts = None if hours is None else NOW - timedelta(hours=hours)
    return (ord, title, link, snippet, ts, source, source, tier, country, lang, unverified, kind)


STORIES = [
    raw(1, "Toyota plans expansion of its dealer network expansion for car owners", "https://a.example/toyota?utm_source=rss",
        "The brand will open new service centre sites so that every workshop has room for more vehicles next year."),
    raw(2, "PM2.5 rises again and car air conditioning cleaning is advised", "https://gov.example/pm", "Mold and bacteria in car cabins; cabin air quality.", tier=1, hours=10),
    raw(3, "แบรนด์ Wizard ลดราคา บริการล้างแอร์รถยนต์ แรง", "https://b.example/wizard", "ศูนย์บริการและคาร์แคร์แข่งราคา", lang="th"),
    raw(4, "EV sales Thailand keep growing", "https://c.example/ev", "Every electric vehicle needs a workshop with EV service network.", hours=9),
    raw(5, "Wizard of Oz returns to cinemas", "https://d.example/oz", "The musical opens on Friday."),
    raw(6, "Wise cuts money transfer fees", "https://e.example/wise", "Remittance prices fall."),
    raw(7, "Toyota plans expansion of its dealer network expansion for car owners", "https://www.a.example/toyota?fbclid=1", "Short copy."),
    raw(8, "Toyota plans an expansion of the dealer network for car owners", "https://f.example/toyota-grows", "Other outlet, other words.", source="daily", tier=1),
    raw(9, "old car sales Thailand report", "https://g.example/old", "used car market", hours=100),
    raw(10, "", "https://h.example/empty"),
    raw(11, "unsafe car", "javascript:alert(1)"),
    raw(12, "my horoscope and car sales Thailand", "https://i.example/stars", "used car market"),
]


@pytest.fixture(scope="module")
def report(spark):
    df = spark.createDataFrame(STORIES, RAW_ITEM)
    return run_daily(df, now(), VEHICLE_CARE_LEXICON, VEHICLE_CARE_RULES)


def test_daily_pipeline(spark, report):
    items = {r["ord"]: r for r in report.items.collect()}
    counts = report.funnel.first()
    assert counts["total_collected"] == 12 and counts["after_normalize"] == 10 and counts["after_recency"] == 9
    assert counts["after_dedup"] == 7
    assert {2, 3, 4, 8} <= set(items) and not {1, 5, 6, 7, 9, 12} & set(items)
    # The official copy leads its group and lists the other outlet once.
    nested = {r["ord"]: r for r in dedup.nest_coverage(report.items, report.coverage).collect()}
    assert [c["url"] for c in nested[8]["related_coverage"]] == ["https://a.example/toyota"] and nested[2]["related_coverage"] == []
    assert items[8]["coverage_count"] == 1
    assert items[8]["duplicate_group_id"] is not None
    assert items[3]["affected_competitors"] == ["Wizard"] and items[3]["classification"] == "negative"
    assert items[4]["time_horizon"] == "long-term" and items[4]["news_category"] == "EV"
    assert all(r["confidence"] <= 75 for r in items.values())
    assert all(r["analyzed_by"] == "fallback" for r in items.values())
    weights = [abs(r["impact_score"]) * r["confidence"] / 100 + r["relevance_score"] / 100 for r in report.items.collect()]
    assert weights == sorted(weights, reverse=True)
    kpi = report.kpi.first()
    assert kpi["positive"] + kpi["neutral"] + kpi["negative"] == kpi["published"] == len(items)
    assert kpi["competitor_alerts"] == 1 and kpi["ev_related"] == 1
    assert quality.violations(report.items.withColumn("title_local", F.col("title_local")), quality.ANALYSIS_RULES).where(F.size("violations") > 0).isEmpty()
    brief = report.briefing.first()
    assert len(brief["risk_signals"]) >= 1 and brief["actions_to_monitor"][0]["related_ids"] == [items[3]["id"]]
    health = spark.createDataFrame([("a", True, None), ("b", False, False)], "source_id string, ok boolean, configured boolean")
    errors = spark.createDataFrame([], "scope string, message string")
    entry = index_entry(report, health, errors, F.lit(date(2026, 7, 21)), now()).first()
    assert entry["status"] == "ok" and entry["total"] == len(items)


def test_empty_day(spark, report):
    empty = report.items.limit(0)
    b = briefing(empty).first()
    assert b["urgency_level"] == "low" and "Nothing about us" in b["executive_summary"]
    funnel = collect_funnel(spark.createDataFrame(STORIES[9:11], RAW_ITEM), now(), VEHICLE_CARE_LEXICON)
    assert collect_preview(funnel).isEmpty()


def test_lexicon_guards(spark):
    rows = [
        (1, "Otherwise a car story", "", 2, "TH"),
        (2, "Wizard opens car care workshop", "", 2, "TH"),
        (3, "Wizard game about cars", "", 2, "TH"),
        (4, "sponsored car sales Thailand", "press release", 3, "SG"),
    ]
    df = spark.createDataFrame(rows, "ord int, title string, snippet string, source_tier int, source_country string")
    got = {r["ord"]: r for r in lexicon.score(df, VEHICLE_CARE_LEXICON).collect()}
    assert got[1]["matched_competitors"] == [] and got[3]["matched_competitors"] == []
    assert got[2]["matched_competitors"] == ["Wizard"] and got[2]["prefilter_score"] == 12 + 6
    # 6 for the term, 4 + 3 for the countries, -3 for the tier, -4 for the marker
    assert got[4]["prefilter_score"] == 6 and got[4]["is_sponsored"] and got[4]["is_press_release"]


def test_stored_queries(spark):
    rows = queries.all_queries(spark, VEHICLE_CARE_LEXICON).collect()
    keys = [(r["language"], r["q"].lower()) for r in rows]
    assert len(keys) == len(set(keys)) == 68 + 6 * 6 + 4
    docs = spark.createDataFrame([(1, "PM2.5 ฝุ่นละออง ยอดขายรถ EV เพิ่ม"), (2, "c++ and EV-sales")], "id int, text string")
    terms = spark.createDataFrame([("pm2.5",), ("ฝุ่น",), ("ยอดขายรถ EV",), ("C++",), ("sale",), ("EV",)], "term string")
    got = {(r["id"], r["term"]) for r in queries.match_terms(docs, terms, "id", "text").collect()}
    assert got == {(1, "pm2.5"), (1, "ฝุ่น"), (1, "ยอดขายรถ EV"), (1, "EV"), (2, "C++"), (2, "EV")}


def test_clustering_equals_brute_force(spark, sf):
    items = dedup_items(spark, sf)
    exact = dedup.exact_groups(items)
    roots = items.join(exact.where("ord = root"), "ord", "left_semi").cache()
    rows = [dict(ord=r["ord"], title=r["title"], snippet=r["snippet"], ts=r["published_at"]) for r in roots.collect()]
    want = brute.leaders(rows)
    one_batch = dedup.DedupOptions()
    many_batches = dedup.DedupOptions(pairs_per_item=0, min_pair_budget=100_000)
    for options in (one_batch, many_batches):
        got = {r["ord"]: r["leader"] for r in dedup.cluster(roots, options).collect()}
        assert got == want


def test_group_rules(spark):
    def item(ord, title, days, tier=2, source="s"):
        ts = NOW - timedelta(days=days)
        return (ord, f"id{ord}", f"https://x.example/{ord}", f"h{ord}", title, "", ts, f"{source}{ord}", tier, False)

    rows = [
        item(1, "budget airline opens new northern route", 0),
        item(2, "budget airline opens northern route today again", 0, tier=1),
        item(3, "quarterly river festival draws record crowd downtown", 0),
        item(4, "quarterly river festival meeting plans parking downtown", 42),
    ]
    schema = "ord bigint, id string, canonical_url string, content_hash string, title string, snippet string, published_at timestamp, source_name string, source_tier int, unverified boolean"
    result = dedup.deduplicate(spark.createDataFrame(rows, schema))
    items = {r["ord"]: r for r in result.items.collect()}
    assert set(items) == {2, 3, 4}
    assert items[2]["duplicate_group_id"] == "id1" and items[2]["coverage_count"] == 1
    stats = result.stats.first()
    assert (stats["items_in"], stats["items_out"], stats["duplicates_removed"], stats["promotions"], stats["groups"]) == (4, 3, 1, 1, 1)


def test_range_merge_vector_and_chains(spark):
    day = lambda d: date(2026, 7, d)
    schema = "ord bigint, date date, id string, content_hash string, canonical_url string, source_tier int, impact_score int"
    rows = [
        (1, day(21), "a", "ha", "ua", 2, 3), (2, day(21), "d", "hd", "u1", 2, 1), (3, day(20), "b", "hb", "ub", 2, -4),
        (4, day(20), "d2", "hd", "u2", 1, 3), (5, day(19), "c", "hc", "uc", 2, 0),
        # a chain over URL and fingerprint, and rows without any key but the id
        (6, day(19), "e", "h6", "u6", 2, 1), (7, day(18), "f", "h7", "u6", 2, 5), (8, day(17), "g", "h7", "u8", 2, 5), (9, day(16), "k", "", None, None, None),
        (10, day(15), "k", None, "", None, None),
    ]
    got = {r["first_ord"]: r for r in ranges.merge_items(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 9}
    assert got[2]["id"] == "d2" and got[2]["report_dates"] == [day(21), day(20)]
    assert got[6]["id"] == "f" and got[6]["report_dates"] == [day(19), day(18), day(17)]
    assert got[9]["report_dates"] == [day(16), day(15)]


def test_demand_signals(spark):
    def run(cities):
        rows = [(i, name, float(w), float(f), pm) for i, (name, w, feels, pm) in enumerate(cities) for f in feels]
        df = spark.createDataFrame(rows, "ord int, city string, weight double, feels_like double, pm25 double")
        return signals.weather_signals(signals.city_peaks(df), now()).collect()

    assert run([("bkk", 1, [30, 31, 30], 10.0)]) == []
    heat = run([("bkk", 5, [40, 40], None), ("small", 1, [28, 28], None)])
    assert len(heat) == 1 and "maximum of 38°C" in heat[0]["title"]
    assert len(run([("bkk", 1, [41], 70.0)])) == 2
    dust = run([("bkk", 1, [30], 60.0)])
    assert len(dust) == 1 and "PM2.5" in dust[0]["title"]


def test_robots(spark):
    files = spark.createDataFrame(
        [("https://a.example", "User-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /private-area/deep # c\nDisallow:"), ("https://b.example", "User-agent: newsbot\nDisallow: /")],
        "origin string, body string",
    )
    rules = robots.robots_rules(files, "NewsBot/2.0")
    urls = ["https://a.example/x", "https://a.example/private-area/deep/1", "https://a.example/private-area/", "https://b.example/", "https://c.example/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "ord int, url string")
    assert {r["ord"] for r in robots.allowed_by_robots(pages, rules).collect()} == {0, 2, 4}


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = [(date(2026, 7, d), f"{d}-{i}", 1) for d in (19, 20, 21) for i in range(2)]
    df = spark.createDataFrame(rows, "date date, id string, impact_score int")
    store.write_day(df, path)
    store.write_day(df.where(F.col("id") == "20-0"), path)
    with pytest.raises(ValueError):
        store.write_day(df.withColumn("impact_score", F.lit(9)), path, (quality.in_range("impact_score", -5, 5),))
    index = spark.createDataFrame([(date(2026, 7, 20),), (date(2026, 7, 21),)], "date date")
    assert store.prune(spark, path, index) == [date(2026, 7, 19)]
    assert store.read_report(spark, path, "2026-07-20").count() == 1
    assert store.read_report(spark, path, "../etc") is None and store.read_report(spark, path, "2020-01-01") is None
    latest = store.read_latest(spark, path, index)
    assert {str(r["date"]) for r in latest.collect()} == {"2026-07-21"}
    assert store.has_new_rows(df, None) and not store.has_new_rows(latest, df)


def test_order_of_large_numbers(spark):
    from briefloom.sources import items

    a = spark.createDataFrame([(1 << 40, "a1"), (5, "a0")], "k bigint, title string")
    b = spark.createDataFrame([(0, 1 << 50, "b1"), (0, 3, "b0"), (1 << 33, 0, "b2")], "k bigint, l bigint, title string")
    got = items.ordered_union([(a, ["k"]), (b, ["k", "l"])]).orderBy("ord").collect()
    assert [(r["ord"], r["title"]) for r in got] == list(enumerate(["a0", "a1", "b0", "b1", "b2"]))


def test_coverage_of_a_large_group(spark):
    schema = "ord bigint, id string, canonical_url string, content_hash string, title string, snippet string, published_at timestamp, source_name string, source_tier int, unverified boolean"
    rows = [(i, f"id{i}", f"https://x.example/{i}", "same", "one story", "", NOW, f"s{i}", 2, False) for i in range(1_500)]
    result = dedup.deduplicate(spark.createDataFrame(rows, schema))
    item = result.items.first()
    assert item["coverage_count"] == 1_499 and result.coverage.count() == 1_499
    assert len(dedup.nest_coverage(result.items, result.coverage).first()["related_coverage"]) == 1_499


def test_exact_groups_are_complete(spark):
    rows = [(1, "U1", "H1"), (2, "U1", "H2"), (3, "U2", "H2"), (4, "U3", "H3"), (5, None, "H3"), (6, "U6", None)]
    df = spark.createDataFrame(rows, "ord bigint, canonical_url string, content_hash string")
    assert {r["ord"]: r["root"] for r in dedup.exact_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_last_view_count_wins(spark):
    from briefloom.sources import payloads

    body = '{{"items": [{{"id": "v", "statistics": {{"viewCount": "{}"}}}}]}}'
    df = spark.createDataFrame([(1, body.format(900)), (2, body.format(700))], "ord bigint, body string")
    assert payloads.video_stats(df).collect()[0]["views"] == 700


def test_one_day_range_keeps_the_stored_verdict(spark):
    from briefloom.plans.range_report import range_report

    day = date(2026, 7, 21)
    rows = [(day, 1, "a", "h1", "u1", 2, 4, "positive"), (day, 2, "b", "h2", "u2", 2, 4, "negative")]
    items = spark.createDataFrame(rows, "date date, ord bigint, id string, content_hash string, canonical_url string, source_tier int, impact_score int, classification string")
    kpis = spark.createDataFrame([(day, 2, 1, 1)], "date date, published bigint, positive bigint, negative bigint")
    days = spark.createDataFrame([(day, "ok", 5.6, "positive", "quiet")], "date date, status string, net_impact_score double, overall_sentiment string, summary string")
    report = range_report(items, kpis, days, days.select("date"))
    summary = report.summary.first()
    assert (summary["overall_sentiment"], summary["net_impact_score"], summary["summary"], summary["is_range"]) == ("positive", 5.6, "quiet", False)
    assert report.kpi.first()["published"] == 2 and report.items.count() == 2


def test_merge_without_and_with_closure(spark):
    day = lambda d: date(2026, 7, d)
    # The third row connects the first two, which are different stories until then.
    rows = [(1, day(21), "a", "h1", "u1", 2, 1), (2, day(20), "b", "h2", "u2", 2, 1), (3, day(19), "c", "h2", "u1", 2, 1)]
    df = spark.createDataFrame(rows, "ord bigint, date date, id string, content_hash string, canonical_url string, source_tier int, impact_score int")
    assert {r["first_ord"] for r in ranges.merge_items(df).collect()} == {1, 2}
    assert {r["first_ord"] for r in ranges.merge_items(df, closure=True).collect()} == {1}


def test_model_failures_fall_back_to_rules(spark, report):
    from briefloom.operators.enrich import enrich

    def broken(batches):
        for _ in batches:
            raise RuntimeError("no answer")
            yield

    items = report.items.drop("analyzed_by", "analysis_model")
    done = enrich(items, VEHICLE_CARE_RULES, None, broken)
    assert {r["analyzed_by"] for r in done.items.collect()} == {"fallback"}
    errors = done.errors.collect()
    assert len(errors) == items.count() and all("RuntimeError: no answer" in r["message"] for r in errors)
    assert done.fresh.isEmpty()


def test_sets_that_many_items_share_are_compared_once(spark):
    """Copies of a title are one set, so the blocks and the exact check see three sets of 302 items, and every edge is found."""
    title = "solid state cells reach the market in spring"
    rows = [(i, title, None, None) for i in range(300)] + [(300, title + " soon", None, None), (301, "an unrelated line of words", None, None)]
    items = spark.createDataFrame(rows, "ord long, title string, snippet string, published_at timestamp")
    options = pairs.SimilarityOptions()
    index = pairs.item_index(pairs.item_features(items, options), options)
    assert index.sets.where("fam = 0").count() == 3
    found = {(r.a, r.b): r for r in pairs.linked_items(index, options).collect()}
    assert set(found) == {(a, b) for a in range(301) for b in range(a + 1, 301)}
    assert all(r.by_title and (r.title_similarity == 1.0) == (r.b < 300) for r in found.values())


def test_packed_signatures_are_those_of_the_expression(spark):
    """A signature of many words folds to the one that Spark's expression gives."""
    rng = random.Random(3)
    df = spark.createDataFrame([(0, i, [rng.getrandbits(62) - 2**61 for _ in range(n)]) for i, n in enumerate((1, 60, 400))], "fam int, sid long, set array<bigint>")
    packed = {r.sid: r for r in pairs.signed(df, {0: 0.33}).collect()}
    plain = df.select("sid", F.explode("set").alias("h")).groupBy("sid").agg(*pairs._signature(F.col("h")))
    for r in plain.collect():
        words = [int.from_bytes(packed[r.sid].sig[8 * i : 8 * i + 8], "little") for i in range(packed[r.sid].words)]
        width = min(len(words), pairs.SIGNATURE_WORDS)
        want = [0] * width
        for i in range(pairs.SIGNATURE_WORDS):
            want[i % width] ^= r[f"s{i}"] % 2**64
        got = [0] * width
        for i, w in enumerate(words):
            got[i % width] ^= w
        assert got == want


def test_signatures_never_rule_out_a_similar_pair(spark):
    """Differing signature bits are at most the shingles of only one set, and pairs far apart differ in many."""
    rng = random.Random(12)
    base = [rng.getrandbits(60) for _ in range(4_000)]
    sets = [(i, rng.sample(base, rng.choice([1, 3, 40, 600]))) for i in range(40)]
    sets += [(100 + i, s[: len(s) * 9 // 10] + [rng.getrandbits(60)]) for i, s in sets]
    df = spark.createDataFrame(sets, "ord long, set array<bigint>")
    words = df.select("ord", F.explode("set").alias("h")).groupBy("ord").agg(*pairs._signature(F.col("h")))
    a, b = (words.select(*[F.col(c).alias(f"{side}_{c}") for c in words.columns]) for side in "ab")
    both = a.join(b, F.col("a_ord") < F.col("b_ord")).select("a_ord", "b_ord", pairs.differing_shingles().alias("bits"))
    own = {i: set(s) for i, s in sets}
    far = {(r.a_ord, r.b_ord): (r.bits, len(own[r.a_ord] ^ own[r.b_ord])) for r in both.collect()}
    assert all(bits <= apart for bits, apart in far.values())
    assert all(bits > 300 for bits, apart in far.values() if apart > 900)
    found = {(r.a, r.b) for r in pairs.similar_pairs(df, "ord", F.col("set").cast("array<string>"), 0.6).where("similarity < 1").collect()}
    want = {p for p, (_, apart) in far.items() for n in [len(own[p[0]] | own[p[1]])] if 0.6 <= 1 - apart / n < 1}
    assert found == want and len(want) > 15


def test_phrases_words_and_other_terms(spark):
    """Phrases probe by pairs, words by themselves, the rest by their characters; edges and what stands between count."""
    texts = {
        1: "Car wash, car  wash and car-wash.", 2: "the car washing", 3: "scar wash", 4: "wash (car wash) now", 5: "ล้างแอร์ car wash ล้าง", 6: None, 7: "",
        8: "a b c d a b d", 9: "car. Wash", 10: "c++ and c# in .net", 11: "the the the car", 12: "CAR\nWASH",
    }
    terms = ["car wash", "car  wash", "car-wash", "Car Wash,", "(car wash)", "wash car", "a b c", "b d", "c d a", "a b d", "the", "the the", "ล้าง", "แอร์ car", "c++", ".net",
             "car. wash", " ", "", None, "car\nwash", "no such phrase", "d"]
    docs = spark.createDataFrame(list(texts.items()), "k long, body string")
    table = spark.createDataFrame([(t, 1) for t in terms] + [("the", 2)], "term string, n int")
    got = sorted((r.k, r.term) for r in queries.match_terms(docs, table, "k", "body").collect())
    want = []
    for k, text in texts.items():
        for t in terms:
            needle = (t or "").lower().strip(" ")
            low = (text or "").lower()
            latin = bool(re.fullmatch("[ -~]+", needle))
            if needle and (re.search("(^|[^a-z0-9])" + re.escape(needle) + "([^a-z0-9]|$)", low) if latin else needle in low):
                want.append((k, t))
    assert got == sorted(want)


def test_cached_rows_expire_without_coming_again(spark, tmp_path):
    """Three batches: a key that never comes again is gone, a renewed one stays, older and late rows change nothing."""
    from briefloom.streaming.cache_state import cache_changes, live_rows, write_changes

    day = datetime(2026, 1, 1)
    batches = [
        [("gone", day, 1), ("kept", day, 2), ("tie", day, 3), ("tie", day, 4), (None, day, 5), ("undated", None, 6)],
        [("kept", day + timedelta(days=4), 7), ("kept", day + timedelta(days=1), 8), ("new", day + timedelta(days=9), 9)],
        [("late", day + timedelta(days=2), 10), ("tie", day, 11), ("kept", day + timedelta(days=8), 12)],
    ]
    schema = "k string, at timestamp, n long"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    changes = cache_changes(stream, "k", "at", "n", timedelta(days=5), late="1 day")
    write_changes(changes, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert sorted((r.k, r.at, r.n) for r in live_rows(spark, str(tmp_path / "log"), stream.schema, "k").collect()) == [
        ("kept", day + timedelta(days=8), 12), ("new", day + timedelta(days=9), 9)
    ]
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.k, r.n) for r in log if r.expired) == [("gone", 1), ("tie", 4)]
    assert not any(r.k in (None, "undated", "late") for r in log)


def test_stages_are_counted_by_the_write(spark):
    """The counts come from one write, cover empty stages, and the one-row table reads nothing."""
    from briefloom.operators.counters import StageCounts
    from briefloom.session import materialize

    seen = StageCounts()
    rows = seen.at(spark.range(0, 1_000, 1, 7), all=None, odd=F.col("id") % 2 == 1)
    kept = seen.at(rows.where("id >= 900"), late=None)
    materialize(seen.at(kept.where("id < 0"), never=None), "kept")
    assert seen.values() == {"all": 1_000, "odd": 500, "late": 100, "never": 0}
    row = seen.row(spark, "late", "never")
    assert row.first().asDict() == {"late": 100, "never": 0} and "Scan" not in row._jdf.queryExecution().executedPlan().toString().replace("Scan OneRow", "")
    empty = StageCounts()
    materialize(empty.at(spark.createDataFrame([], "a int"), none=None), "empty")
    assert empty.values() == {"none": 0}


def test_tables_are_shown_at_once(spark, tmp_path):
    """Staged folders stay hidden until the commit; repeated, killed and expired days leave no folders behind."""
    from briefloom.operators.manifest import DayStore

    store_of = DayStore(spark, str(tmp_path / "store"))
    first, second = date(2026, 7, 20), date(2026, 7, 21)

    def rows(*values):
        return spark.createDataFrame([(v,) for v in values], "n int")

    def held(name):
        return sorted((str(r["date"]), r["n"]) for r in store_of.read(name).collect())

    assert store_of.read("a") is None and store_of.read("a", "n int").collect() == [] and store_of.days("a") == []
    change = store_of.begin()
    change.put("a", rows(1, 2), first)
    change.put("b", rows(3), first)
    change.put("whole", rows(4))
    assert store_of.live() == []
    change.commit()
    reader = store_of.read("a")  # has started: keeps what it sees
    killed = store_of.begin()
    killed.put("a", rows(9), first)
    change = store_of.begin()
    change.put("a", rows(5), first)
    change.put("a", rows(6), second)
    with pytest.raises(ValueError):
        change.put("b", rows(7), first, (quality.in_range("n", 0, 5),))
    assert held("a") == [("2026-07-20", 1), ("2026-07-20", 2)]
    change.commit()
    assert held("a") == [("2026-07-20", 5), ("2026-07-21", 6)] and held("b") == [("2026-07-20", 3)]
    assert sorted(r["n"] for r in reader.collect()) == [1, 2]
    assert [r["n"] for r in store_of.read("whole").collect()] == [4]
    change = store_of.begin()
    assert change.keep_days({second}) == [first]
    change.commit()
    store_of.begin().commit()  # now nothing names the first day any more
    assert held("a") == [("2026-07-21", 6)] and store_of.days("a") == [second]
    assert len(list((tmp_path / "store" / "a").glob("date=*/run=*"))) == 1


def test_latest_report_is_pruned_by_a_subquery(spark, tmp_path):
    path = str(tmp_path / "reports")
    store.write_day(spark.createDataFrame([(date(2026, 7, d), d) for d in (19, 20, 21)], "date date, n int"), path)
    index = spark.createDataFrame([(date(2026, 7, 19),), (date(2026, 7, 20),)], "date date")
    latest = store.read_latest(spark, path, index)
    assert [r["n"] for r in latest.collect()] == [20]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "subquery" in plan.lower()
    assert store.read_latest(spark, path, index.limit(0)).collect() == []


def test_update_log_stays_small(spark, tmp_path):
    """Fifty batches: readers see the last value of every key and few folders, also when the last batch is run again."""
    from briefloom.session import partition_values
    from briefloom.streaming import jobs

    path, source = str(tmp_path / "log"), str(tmp_path / "in")
    batches = [[(k, b) for k in range(b % 7, 40, 7)] for b in range(50)]
    want = {k: b for rows in batches for k, b in rows}
    schema = "k int, v int"
    seen = []
    save = jobs.write_updates

    class Writer:  # stands in for the stream's writer, one call per batch
        def __init__(self, frame):
            self.frame = frame

        def __getattr__(self, name):
            return lambda *args, **kwargs: setattr(self, "call", args[0]) or self if name == "foreachBatch" else self

    class Frame:
        def __init__(self, df):
            self.schema, self.writeStream = df.schema, Writer(self)

    first = spark.createDataFrame(batches[0], schema)
    frame = Frame(first)
    save(frame, path, source, ["k"], fanout=4)
    for b, rows in enumerate(batches):
        for _ in range(2 if b in (15, 16, 49) else 1):  # these are retried
            frame.writeStream.call(spark.createDataFrame(rows, schema), b)
        seen.append(len(partition_values(spark, path, "batch_id")))
    assert {r.k: r.v for r in jobs.latest_updates(spark, path, schema, ["k"]).collect()} == want
    assert max(seen) <= 4 * 3 and seen[48] <= 3 + 1


def test_merging_with_an_address_of_half_of_all_rows(spark):
    """Heads equal those of a walk through all items, also where one address, and one fingerprint, are everywhere."""
    rng = random.Random(14)
    rows = []
    for i in range(1_500):
        url = "https://hot.example/" if rng.random() < 0.5 else rng.choice([None, "", *[f"https://e.example/{k}" for k in range(200)]])
        digest = "hot" if rng.random() < 0.2 else rng.choice([None, "", *[f"h{k}" for k in range(400)]])
        rows.append((i, str(i % 600), date(2026, 7, 31) - timedelta(days=i // 100), digest, url))
    heads, by_digest, by_link = {}, {}, {}
    for i, name, _, digest, url in rows:
        link = "u:" + url if url else None if digest else "i:" + name
        up = by_digest.get(digest) if digest and digest in by_digest else by_link.get(link) if link else None
        heads[i] = i if up is None else heads[up]
        if digest:
            by_digest.setdefault(digest, i)
        if link:
            by_link[link] = i
    df = spark.createDataFrame(rows, "ord long, id string, date date, content_hash string, canonical_url string").repartition(5)
    assert {r["ord"]: r["first_ord"] for r in ranges.merge_heads(df).collect()} == heads


def test_feed_entries_are_parsed_once(spark, sf):
    plan = source_queries.feed_raw_items(spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "from_xml" not in plan.lower() and "xmltostructs" not in plan.lower()


def test_enrichment_writes_fingerprints(spark, sf):
    base, cache = item_queries._cached_items(spark, sf)
    for df in (base, cache):
        assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_made_once_per_document(spark):
    docs = spark.createDataFrame([(1, "a (big) dog\nsat"), (2, "x-y \u00e9\U0001f600 z"), (3, None)], "doc_id bigint, text string")
    terms = spark.createDataFrame([("big) dog sat",), ("(big) dog",), ("a (big",), ("y \u00e9\U0001f600",), ("\U0001f600 z",), ("dog\nsat",)], "term string")
    found = queries.match_terms(docs, terms, "doc_id", "text")
    assert {tuple(r) for r in found.collect()} == {(1, "(big) dog"), (1, "a (big"), (2, "y \u00e9\U0001f600"), (2, "\U0001f600 z"), (1, "dog\nsat")}
    above, below = found._jdf.queryExecution().optimizedPlan().toString().rsplit("Generate explode(ts", 1)
    # Below the step that unfolds the terms of a document: there it runs once per document.
    assert f"{queries._EDGE}" in below

    odd = ["", "a b", "\u00e9 a,b;;c", ";\n;", " ;x", "\t;\x00\x1f", "\U0001f600\u0e44 z", "\x85-\u00a0q", None]
    df = spark.createDataFrame([(t,) for t in odd], "c string")
    c = F.col("c")
    rows = df.select(
        F.regexp_extract_all(c, F.lit(queries._WIDE), F.lit(0)), F.regexp_extract_all(c, F.lit("[^a-z0-9\\s][^a-z0-9]*"), F.lit(0)),
        F.regexp_replace(c, queries._EDGE, " "), F.regexp_replace(c, "[^a-z0-9]", " "),
    ).collect()
    for row in rows:
        assert tuple(row[::2]) == tuple(row[1::2])
