"""Exact vectors for the scalar functions."""

from datetime import datetime

from pyspark.sql import functions as F

from briefloom.functions import dates, hashing, numbers, text, urls


def one(spark, build, *values):
    """Evaluate a column builder on one row of strings."""
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    df = spark.createDataFrame([tuple(values)], schema)
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


def canon(spark, *raw):
    df = spark.createDataFrame([(r,) for r in raw], "u string")
    return [r["c"] for r in df.select(urls.canonical_url(F.col("u")).alias("c")).collect()]


def check_all(spark, build, vectors):
    """All vectors of a function in one job."""
    rows = [(i, raw) for i, (raw, _) in enumerate(vectors)]
    df = spark.createDataFrame(rows, "i int, c string").select("i", build(F.col("c")).alias("r"))
    got = {r["i"]: r["r"] for r in df.collect()}
    assert [(raw, got[i]) for i, (raw, _) in enumerate(vectors)] == vectors


STRIP_HTML = [
        ("<p>สวัสดี <b>ครับ</b></p>", "สวัสดี ครับ"),
        ("<style>body{color:red}</style>ข้อความ", "ข้อความ"),
        ("ok<script>alert(1)", "ok"),
        ("a<!-- x > y -->b", "a b"),
        ("a &amp; b &lt;c&gt; &quot;d&quot;", 'a & b <c> "d"'),
        ("&#x0e01;", "ก"),
        ("&#128512;", "😀"),
        ("x&#1;y&#xFFFFFFFFFFFF;z", "xyz"),
        ("&#x26;#x41;", "&#x41;"),
        ("&#38;lt;", "<"),
        ("&amp;lt;", "&lt;"),
        ("&AMP;&unknown;", "&&unknown;"),
        ("<scripted>x</scripted>", "x"),
        ("a<svg/onload=1>b</svg>c", "a c"),
        (None, ""),
]


def test_strip_html(spark):
    check_all(spark, text.strip_html, STRIP_HTML)


def test_whitespace_and_control(spark):
    assert one(spark, text.collapse_whitespace, "  a \n\n  b  ") == "a b"
    assert one(spark, text.remove_control_chars, "a\x00b\x85") == "a b "
    assert one(spark, text.has_control_or_space, "a b") is True
    assert one(spark, text.has_control_or_space, "ab") is False


def test_truncate(spark):
    out = one(spark, lambda c: text.truncate(c, 5), "abcdefghij")
    assert out == "abcd…"
    assert one(spark, lambda c: text.truncate(c, 5), "abcde") == "abcde"
    assert one(spark, lambda c: text.truncate(c, 5), "abc defg") == "abc…"


def test_canonical_url(spark):
    got = canon(
        spark,
        "HTTP://Example.COM/News",
        "https://www.example.com/a",
        "https://example.com/a?utm_source=rss&id=7&fbclid=x",
        "https://example.com/?b=2&a=1",
        "https://example.com/a#section",
        "https://example.com/news/",
        "https://news.google.com/articles/x?url=https://real.co.th/story",
        "https://news.google.com/articles/x?hl=th&url=https%3A%2F%2Freal.co.th%2Fs%3Fa%3D1",
        "https://h/",
        "http://h:80/x",
        "https://h:8443/x//",
        "https://h/a/../b/./c?q=a b",
        "https://h/a/../b/./c?q=a+b&q2=%E0%B8%81",
        "https://h/ข่าว",
        "https://h/?empty&x=",
    )
    assert got == [
        "https://example.com/News",
        "https://example.com/a",
        "https://example.com/a?id=7",
        "https://example.com?a=1&b=2",
        "https://example.com/a",
        "https://example.com/news",
        "https://real.co.th/story",
        "https://real.co.th/s?a=1",
        "https://h",
        "https://h/x",
        "https://h:8443/x//",
        None,
        "https://h/b/c?q=a+b&q2=%E0%B8%81",
        "https://h/%E0%B8%82%E0%B9%88%E0%B8%B2%E0%B8%A7",
        "https://h?empty=&x=",
    ]


def test_unsafe_urls_are_null(spark):
    bad = ["javascript:alert(1)", "data:text/html,x", "file:///etc/passwd", "", None, "not a url", "https://", "https://h:99999/"]
    assert canon(spark, *bad) == [None] * len(bad)
    df = spark.createDataFrame([(u,) for u in bad], "u string")
    assert df.where(urls.is_safe_url(F.col("u"))).isEmpty()


def test_sanitized_url(spark):
    df = spark.createDataFrame([("https://example.com",), ("http://E.com:80/A?x=1#f",), ("ftp://x/",)], "u string")
    assert [r["s"] for r in df.select(urls.sanitize_url(F.col("u")).alias("s")).collect()] == [
        "https://example.com/",
        "http://e.com/A?x=1#f",
        None,
    ]


def test_domain(spark):
    assert one(spark, urls.domain_of, "https://www.news.example/motoring/news-1") == "news.example"
    assert one(spark, urls.domain_of, "garbage") == ""


def test_hashes(spark):
    assert len(one(spark, hashing.id_from_url, "https://example.com/a")) == 16
    a = one(spark, hashing.content_hash, "Car sales, up!", "Body  text")
    b = one(spark, hashing.content_hash, "car sales up", "body TEXT.")
    assert a == b and len(a) == 24
    marks = [one(spark, hashing.content_hash, t, "") for t in ("ที่ดี", "ท ด ")]
    assert marks[0] == marks[1]


PARSE_DATE = [
        ("Tue, 15 Jul 2025 09:30:00 +0700", datetime(2025, 7, 15, 2, 30)),
        ("Tue, 15 Jul 2025 08:00:00 GMT", datetime(2025, 7, 15, 8, 0)),
        ("15 Jul 2025 08:00 EST", datetime(2025, 7, 15, 13, 0)),
        ("2025-07-15T09:30:00Z", datetime(2025, 7, 15, 9, 30)),
        ("2025-07-15T09:30:00.250+07:00", datetime(2025, 7, 15, 2, 30, 0, 250000)),
        ("2025-07-15", datetime(2025, 7, 15)),
        ("15 กรกฎาคม 2568", datetime(2025, 7, 14, 17, 0)),
        ("15 ก.ค. 2568 10:30", datetime(2025, 7, 15, 3, 30)),
        ("๑๕ ก.ค. ๒๕๖๘", datetime(2025, 7, 14, 17, 0)),
        ("15/07/2025", datetime(2025, 7, 14, 17, 0)),
        ("31/02/2025", datetime(2025, 3, 2, 17, 0)),
        ("1899-01-01T00:00:00Z", None),
        ("2999-01-01T00:00:00Z", None),
        ("garbage", None),
        ("45/13/2025", None),
        ("", None),
        (None, None),
]


def test_parse_date(spark):
    now = F.lit("2026-01-01T00:00:00Z").cast("timestamp")
    check_all(spark, lambda c: dates.parse_date(c, now), PARSE_DATE)


def test_epoch_or_date(spark):
    assert one(spark, dates.parse_epoch_or_date, "1753000000") == datetime(2025, 7, 20, 8, 26, 40)
    assert one(spark, dates.parse_epoch_or_date, "2026-07-21T10:00:00Z") == datetime(2026, 7, 21, 10)


def test_lookback_day_and_display(spark):
    ts = lambda c: c.cast("timestamp")
    now = F.lit("2025-07-16T00:00:00Z").cast("timestamp")
    within = lambda c: dates.is_within_lookback(ts(c), 48, now)
    assert one(spark, within, "2025-07-15T00:00:00Z") is True
    assert one(spark, within, "2025-07-13T00:00:00Z") is False
    assert one(spark, within, "2025-07-16T07:00:00Z") is False
    assert one(spark, within, None) is False
    assert str(one(spark, lambda c: dates.date_key(ts(c)), "2025-07-15T23:30:00Z")) == "2025-07-16"
    assert one(spark, lambda c: dates.format_local(ts(c)), "2025-07-15T09:30:00Z") == "15 ก.ค. 2568 16:30"
    assert one(spark, lambda c: dates.format_local(ts(c)), None) == ""


def test_tokens_trigrams_similarity(spark):
    assert one(spark, text.tokenize, "The quick brown fox") == ["quick", "brown", "fox"]
    assert sorted(one(spark, text.trigrams, "ab cd")) == ["abc", "bcd"]
    assert one(spark, text.trigrams, "ab") == []
    assert one(spark, text.similarity, "same title here", "same title here") == 1.0
    assert one(spark, text.similarity, "alpha beta", "gggg hhhh") == 0.0
    assert one(spark, text.similarity, "", "x") == 0.0
    jac = lambda a, b: text.jaccard(F.split(a, " "), F.split(b, " "))
    assert one(spark, jac, "a b c", "b c d") == 0.5


def test_contains_term(spark):
    hay = "otherwise wise-up, c++ ศูนย์บริการรถ"
    test = lambda term: one(spark, lambda c: text.contains_term(c, term), hay)
    assert test("WISE") and test("c++") and test("บริการ")
    assert not test("other") and not test("rwise") and not test(" ")
    assert one(spark, lambda c: text.contains_any(c, ["zzz", "wise"]), hay) is True


def test_small_helpers(spark):
    assert (
        one(spark, text.strip_highlight, "{{em}}ล้าง{{eem}}{{em}}แอร์{{eem}}รถยนต์แบบไหนดี") == "ล้างแอร์รถยนต์แบบไหนดี"
    )
    snippet = one(spark, lambda d, c, v: text.build_video_snippet(d, c, v.cast("bigint")), "desc", "chan", "12000")
    assert snippet == "desc (ช่อง: chan) · ยอดวิว 12,000 ครั้ง"
    assert "ยอดวิว" not in one(spark, lambda d, c: text.build_video_snippet(d, c, F.lit(None).cast("bigint")), "d", "c")
    body = '{"error":{"message":"quota exceeded","errors":[{"reason":"quotaExceeded"}]}}'
    assert one(spark, text.api_error_reason, body) == "quotaExceeded: quota exceeded"
    assert one(spark, text.api_error_reason, '{"items":[]}') is None
    assert one(spark, text.api_error_reason, "<html>") is None
    group = lambda i, n: text.source_group(i, n)
    assert one(spark, group, "youtube", "x") == "YouTube"
    assert one(spark, group, "pantip:a", "x") == "Pantip"
    assert one(spark, group, "rss", "x") == "x"


def test_rounding(spark):
    num = lambda f: (lambda c: f(c.cast("double")))
    assert one(spark, num(numbers.round_int), "-2.5") == -2
    assert one(spark, num(numbers.round1), "2.25") == 2.3
    assert one(spark, num(numbers.trunc), "-1.8") == -1
    assert one(spark, num(lambda c: numbers.clamp(c, -5.0, 5.0)), "9") == 5.0


def _first_topic_list(node, depth=0, limit=8):
    if depth > limit or not isinstance(node, (dict, list)):
        return None
    if isinstance(node, list) and node and isinstance(node[0], dict) and "title" in node[0] and ("id" in node[0] or "topic_id" in node[0]):
        return node
    for child in node if isinstance(node, list) else node.values():
        found = _first_topic_list(child, depth + 1, limit)
        if found is not None:
            return found
    return None


def test_topic_lists_of_unknown_layout(spark):
    """The first list in document order, as a search of the parsed document finds it; no Python in the plan."""
    import json
    import random

    from pyspark.sql import functions as F

    from briefloom.sources.embedded import topics_of, with_topic_list

    rng = random.Random(9)

    def value(depth):
        kind = rng.choice("oooaaats") if depth else "s"
        if kind == "o":
            return {rng.choice(["z", "b", "title", "id", "topic_id", "m", "0"]): value(depth - 1) for _ in range(rng.randrange(4))}
        if kind == "a":
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == "t":
            return [{"title": rng.choice(["é\"x", None]), rng.choice(["id", "topic_id", "no"]): rng.randrange(99)}, 5, None, "s", {"id": "x"}]
        return rng.choice([None, True, 1, 2.5, "text", '[{"title": 1, "id": 2}]', "{}", ""])

    docs = [json.dumps(value(6), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(300)]
    deep = json.dumps([{"title": "t", "id": 7}])
    docs += ['{"a":' * n + deep + "}" * n for n in (7, 8, 9)] + ["", "{bad", '{"a": [', "[]", "null", "3", '"[{}]"', None]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    found = with_topic_list(df, "doc", "found").withColumn("topics", topics_of(F.col("found")))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    hits = 0
    for r in found.collect():
        try:
            want = _first_topic_list(json.loads(r.doc)) if r.doc else None
        except ValueError:
            want = None
        assert (None if r.found is None else json.loads(r.found)) == want, r.doc
        hits += want is not None
        if want is not None:
            rows = [t for t in want if isinstance(t, dict)]
            assert len(r.topics) == len(rows)
            for got, row in zip(r.topics, rows):
                for have, one in ((got.title, row.get("title")), (got.id, row.get("id"))):
                    assert have == one if one is None or isinstance(one, str) else json.loads(have) == one  # nested values stay JSON
    assert hits > 60


def test_text_passes_read_a_text_once(spark):
    ws = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
    odd = [
        "", " ", "a", " a", "a ", "a  b", "a\tb", "a \n b\n", "a\x85", "a \x85", "\x85a", "a\u00a0\u00a0b", "\ufeffx \u2028", "\x00a\x1f \x7fb\x9f", "A--b  c1",
        "caf\u00e9 \u0e44\u0e17\u0e22, 1\u00bd _x_", "a<b>c</b> d", "x &amp; y&#10;z", "e\u0301 \U0001f600 q", "\n", "- -", None,
    ]
    df = spark.createDataFrame([(t,) for t in odd], "c string")
    c = F.col("c")
    two_passes = lambda x: F.trim(F.regexp_replace(x, f"{ws}+", " "))
    rows = df.select(
        text.collapse_whitespace(c), two_passes(c),
        text.trim_ws(c), F.regexp_replace(c, f"^{ws}+|{ws}+$", ""),
        text.strip_html(c), F.coalesce(two_passes(text.remove_control_chars(text.decode_entities(text._without_tags(c)))), F.lit("")),
        text.spaced_words(c), two_passes(text.normalize_words(c)),
    ).collect()
    for row in rows:
        assert tuple(row[::2]) == tuple(row[1::2])
    hashed = df.select(hashing.content_hash(F.lit("t"), c).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert hashed.count("regexp_replace") == 1  # the title is folded


def test_terms_start_the_search(spark):
    hays = ["", "is", "this is", "this", "xis isx is-", "is\n", "\u00e9is", "c++ a", "ac++", "c++", "of the", "of  the", "often of thee of the", "isis", "aais is", None]
    terms = ["is", "c++", "of the", "++", "s", "isis", "\u00e9i"]
    df = spark.createDataFrame([(h,) for h in hays], "c string")
    edge = lambda t: F.col("c").rlike(f"(^|[^a-z0-9]){text.regex_quote(t)}([^a-z0-9]|$)") if text.is_latin_term(t) else F.col("c").contains(t)
    for row in df.select(*[x for t in terms for x in (text.contains_term(F.col("c"), t), edge(t))]).collect():
        assert tuple(row[::2]) == tuple(row[1::2])
    plan = df.select(text.contains_any(F.col("c"), ["is", "of the"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "(^|" not in plan
