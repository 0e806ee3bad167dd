"""Queries for the sources: Spark wraps whole tables into raw payloads, the operators unwrap them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.functions.hashing import content_hash
from briefloom.operators import aggregates as agg
from briefloom.operators import signals
from briefloom.operators.ranking import first_per_source
from briefloom.session import materialize
from briefloom.sources import embedded, feeds, items, payloads
from briefloom.workload.inputs import document_items, event_reports, now, table
from briefloom.workload.text_queries import sql_content_hash, sql_strip_html

MONTH = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _cdata(c) -> F.Column:
    return F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))


def _feed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One feed document per text, RSS, RDF or Atom in turn; every 20th is broken on purpose."""
    d = document_items(spark, sf)
    key = F.col("ord").cast("string")
    plain = F.regexp_replace("title", "[<>&\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")
    body = _cdata(F.regexp_replace("snippet", "\\]\\]>|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " "))
    link = F.concat(F.lit("https://feed.example.com/"), "language", F.lit("/"), key)
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><title>'), plain, F.lit("</title><link>"), link,
        F.lit("</link><description>"), body, F.lit("</description><pubDate>Tue, 15 Jul 2025 09:30:00 +0700</pubDate><source url=\"x\">pub</source></item></channel></rss>"),
    )
    rdf = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns:content="c"><channel/><item><title>'), plain, F.lit("</title><guid>"), link,
        F.lit("</guid><description> </description><content:encoded>"), body, F.lit("</content:encoded><dc:date>2025-07-15T02:30:00Z</dc:date></item></rdf:RDF>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="a"><title>t</title><entry><title>'), plain, F.lit('</title><link rel="self" href="https://self.example.com/"/><link rel="alternate" href="'), link,
        F.lit('"/><summary>'), body, F.lit("</summary><updated>2025-07-15T02:30:00Z</updated></entry></feed>"),
    )
    style = F.col("ord") % 3
    good = F.when(style == 0, rss).when(style == 1, rdf).otherwise(atom)
    bad = F.when(style == 0, F.lit("")).when(style == 1, F.lit("<html><body>no feed</body></html>")).otherwise(F.substring(good, 1, 60))
    return d.select("ord", "source_id", F.when(F.col("ord") % 20 == 19, bad).otherwise(good).alias("body"))


def feed_parse(spark: SparkSession, sf: str) -> DataFrame:
    entries = feeds.feed_entries(_feed_documents(spark, sf))
    return entries.select(
        F.col("ord").alias("doc_id"), "link", F.length("title").cast("bigint").alias("title_chars"),
        content_hash(F.col("title"), F.col("snippet"), None).alias("text_hash"), F.unix_seconds("published_at").alias("epoch"), "publisher",
    )


def feed_raw_items(spark: SparkSession, sf: str) -> DataFrame:
    """Feed entries to raw items with the attributes of their source, and as entries of a search feed."""
    entries = materialize(feeds.feed_entries(_feed_documents(spark, sf)), "entries")  # read twice, parsed once
    docs = document_items(spark, sf)
    sources = docs.groupBy("source_id").agg(F.first("source_name").alias("source_name"), F.first("source_tier").alias("source_tier")).withColumn(
        "unverified", F.when(F.col("source_tier") == 3, True)
    )
    columns = [F.col("ord").alias("doc_id"), "source_name", "source_tier", "unverified", "item_kind", F.length("snippet").cast("bigint").alias("snippet_chars")]
    own = feeds.feed_items(entries, sources).select(F.lit("feed").alias("kind"), *columns)
    found = feeds.search_feed_items(entries, default_name="search").select(F.lit("search").alias("kind"), *columns)
    return own.unionByName(found)


def feed_check(spark: SparkSession, sf: str) -> DataFrame:
    """Feed check summary: every document is a feed of its own."""
    docs = _feed_documents(spark, sf).withColumn("source_id", F.col("ord"))
    entries = feeds.feed_entries(docs, max_snippet_chars=None).withColumn("title", F.col("link"))
    return agg.feed_check(entries, feeds.feed_errors(docs), docs).select(F.col("source_id").alias("doc_id"), "ok", "entries", "sample", "error")


def news_payload_items(spark: SparkSession, sf: str) -> DataFrame:
    """One news payload per document and its own second article without a link; payloads of src5 failed."""
    d = document_items(spark, sf)
    articles = F.array(
        F.struct("title", F.col("link").alias("url"), F.col("snippet").alias("description"), F.lit("2025-07-15T02:30:00Z").alias("publishedAt"), F.struct(F.col("source_name").alias("name")).alias("source")),
        F.struct("title", F.lit("").alias("url"), F.lit("x").alias("description"), F.lit(None).cast("string").alias("publishedAt"), F.struct(F.lit("n").alias("name")).alias("source")),
    )
    status = F.when(F.col("source_id") == "src5", "error").otherwise("ok")
    body = F.to_json(F.struct(status.alias("status"), articles.alias("articles")))
    out = payloads.news_api_items(d.select("ord", "language", body.alias("body")))
    return out.select(F.col("ord").alias("doc_id"), "link", "source_name", "language", F.unix_seconds("published_at").alias("epoch"), content_hash(F.col("title"), F.col("snippet")).alias("text_hash"))


def post_payload_items(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as page posts; turns without a link get one from their id; system turns are error payloads."""
    c = table(spark, sf, "conversations")
    key = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    link = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://Www.Posts.example.com/p/"), key))
    good = F.to_json(F.struct(F.array(F.struct(key.alias("id"), F.col("text").alias("message"), F.lit("2025-07-15T09:30:00+0700").alias("created_time"), link.alias("permalink_url"))).alias("data")))
    body = F.when(F.col("role") == "system", F.lit('{"error":{"message":"token expired"}}')).otherwise(good)
    out = payloads.post_items(c.select("conv_id", "turn", F.col("role").alias("page_id"), body.alias("body")))
    return out.select("conv_id", "turn", "link", "source_id", F.unix_seconds("published_at").alias("epoch"), content_hash(F.lit(""), F.col("snippet"), None).alias("text_hash"))


def short_video_items(spark: SparkSession, sf: str) -> DataFrame:
    """Events as short videos, one payload per user and type is not needed: each event is its own payload."""
    e = table(spark, sf, "events")
    video = F.struct(F.col("event_id").cast("string").alias("id"), F.concat(F.col("event_type"), F.lit(" &amp; "), "props").alias("video_description"), F.unix_seconds("ts").alias("create_time"))
    body = F.to_json(F.struct(F.struct(F.array(video).alias("videos")).alias("data")))
    out = payloads.short_video_items(e.select("event_id", F.col("event_type").alias("hashtag"), body.alias("body")))
    return out.select("event_id", "title", "link", "source_id", F.unix_seconds("published_at").alias("epoch"))


def video_items(spark: SparkSession, sf: str) -> DataFrame:
    """Search payloads per order, hits per customer: the first hit of a customer wins; view counts joined on."""
    o = table(spark, sf, "orders")
    hit = F.struct(
        F.struct(F.col("o_custkey").cast("string").alias("videoId")).alias("id"),
        F.struct(
            F.concat(F.lit("<b>"), F.col("o_orderpriority"), F.lit("</b>")).alias("title"), F.col("o_orderstatus").alias("description"),
            F.lit("chan").alias("channelTitle"), F.date_format("o_orderdate", MONTH).alias("publishedAt"),
        ).alias("snippet"),
    )
    failed = F.lit('{"error":{"message":"quota","errors":[{"reason":"quotaExceeded"}]}}')
    body = F.when(F.col("o_orderkey") % 50 == 49, failed).otherwise(F.to_json(F.struct(F.array(hit).alias("items"))))
    # Every order reports a view count of its customer, in order; the last one counts.
    stat = F.struct(F.col("o_custkey").cast("string").alias("id"), F.struct(F.floor("o_totalprice").cast("string").alias("viewCount")).alias("statistics"))
    stats = o.select(F.col("o_orderkey").alias("ord"), F.to_json(F.struct(F.array(stat).alias("items"))).alias("body"))
    out = payloads.video_items(o.select(F.col("o_orderkey").alias("ord"), body.alias("body")), payloads.video_stats(stats))
    return out.select("video_id", "query_ord", "title", "link", "snippet", F.unix_seconds("published_at").alias("epoch"))


def api_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error reason of every turn's payload; good payloads and non-JSON have none."""
    c = table(spark, sf, "conversations")
    body = (
        F.when(F.col("role") == "user", F.to_json(F.struct(F.struct(F.col("role").alias("message")).alias("error"))))
        .when(F.col("turn") % 2 == 0, F.lit("<html>"))
        .otherwise(F.lit('{"error":{"message":"m","errors":[{"reason":"keyInvalid"}]}}'))
    )
    return payloads.api_errors(c.select("conv_id", "turn", body.alias("body"))).select("conv_id", "turn", "error")


def _topic_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    topic = F.struct(
        F.col("page_id").cast("string").alias("id"), F.concat(F.lit("{{em}}page{{eem}} "), F.col("page_id").cast("string")).alias("title"),
        F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("detail"), F.lit(1752546600).alias("created_time"),
    )
    second = F.struct(
        F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("topic_id"), F.lit("comment only").alias("title"), F.lit("{{em}}hit{{/em}}").alias("comment"),
        F.lit("2025-07-15T02:30:00Z").alias("last_reply_time"), F.col("url").alias("url"),
    )
    lists = F.concat(F.lit("["), F.to_json(topic), F.lit(","), F.to_json(second), F.lit("]"))
    doc = F.concat(F.lit('{"props":{"menu":[{"label":"home"}],"pageProps":{"data":{"topics":'), lists, F.lit("}}}}"))
    doc = F.when(F.col("page_id") % 10 == 9, F.lit("{ broken")).otherwise(doc)
    safe = F.replace(doc, F.lit("</script>"), F.lit(" "))
    html = F.concat(F.col("html"), F.lit('<script id="__NEXT_DATA__" type="application/json">'), safe, F.lit("</script>"))
    return p.select("page_id", html.alias("html"))


def _topic_rows(topics: DataFrame) -> DataFrame:
    out = embedded.topic_items(topics, ("page_id",), F.lit("cars"), F.lit("tag"), "Pantip", "https://pantip.com/topic/")
    return out.select(
        "page_id", F.col("entry_pos").cast("int").alias("pos"), "title", "link", F.unix_seconds("published_at").alias("epoch"),
        F.sha2("snippet", 256).alias("snippet_sha"), "source_name",
    )


def embedded_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic list searched for in the embedded JSON of every page."""
    return _topic_rows(embedded.forum_topics(_topic_pages(spark, sf)))


def embedded_topics_known_path(spark: SparkSession, sf: str) -> DataFrame:
    """The same topics at a known JSON path, without Python."""
    return _topic_rows(embedded.forum_topics(_topic_pages(spark, sf), path="$.props.pageProps.data.topics"))


def forecast_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Daily lists per user wrapped as forecast payloads and unrolled again; some felt values are missing."""
    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.max("value").alias("v"), F.min(F.when(F.col("event_type") == "view", F.col("value"))).alias("f")
    )
    lists = days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "v", "f"))).alias("l"))  # at most one entry per day
    daily = F.struct(
        F.transform("l", lambda x: x["d"].cast("string")).alias("time"), F.transform("l", lambda x: x["v"]).alias("temperature_2m_max"),
        F.transform("l", lambda x: x["f"]).alias("apparent_temperature_max"),
    )
    hourly = F.struct(F.transform("l", lambda x: x["f"]).alias("pm2_5"))
    options = {"ignoreNullFields": "false"}
    body = lists.select("user_id", F.to_json(F.struct(daily.alias("daily"), hourly.alias("hourly")), options).alias("body"))
    peak = payloads.hourly_max(body)
    return payloads.forecast_days(body).join(peak, "user_id").select("user_id", "day", "temp_max", "feels_like", "pm25")


def _cities(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("city"), (F.col("n_regionkey") + 1).cast("double").alias("weight"),
        (F.col("o_totalprice") / 6000).alias("feels_like"), F.when(F.col("n_nationkey") % 3 != 0, F.col("c_acctbal") / 100).alias("pm25"),
    )


def weighted_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Peak and mean per nation with the weighted average over all nations."""
    from briefloom.session import with_scalars

    cities = signals.city_peaks(_cities(spark, sf))
    total = cities.agg(
        F.round(agg.weighted_average(F.col("mean"), F.col("weight")), 6).alias("weighted"),
        signals.arg_max(F.col("city"), F.col("peak"), F.col("ord")).alias("hottest"),
    )
    return with_scalars(cities.select("city", F.round("peak", 6).alias("peak"), F.round("mean", 6).alias("mean")), total)


def demand_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Raw signal items from the nations' values."""
    out = signals.weather_signals(signals.city_peaks(_cities(spark, sf)), now())
    return out.select("ord", "title", "snippet", "link", "source_name", "source_tier", "item_kind")


def _all_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = document_items(spark, sf).select("ord", "title", "link", "snippet", "published_at", "source_id", "source_name", "source_tier")
    posts = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("title"), F.lit("https://p.example.com/").alias("link"), F.col("role").alias("source_id"),
        F.col("role").alias("source_name"), F.lit(3).alias("source_tier"), F.lit("social").alias("item_kind"), F.lit(True).alias("unverified"),
    )
    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("snippet"), F.col("url").alias("link"),
        F.lit("web").alias("source_id"), F.lit("web").alias("source_name"),
    )
    return items.ordered_union([(docs, ["ord"]), (posts, ["conv_id", "turn"]), (pages, ["page_id"])])


def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources in one item table, numbered in source order."""
    return _all_sources(spark, sf).select(
        "ord", "source_id", "item_kind", "unverified", F.length("title").cast("bigint").alias("title_chars"), F.length("snippet").cast("bigint").alias("snippet_chars")
    )


def source_caps(spark: SparkSession, sf: str) -> DataFrame:
    """The limit per source of a collection run: the first 20 items of each."""
    return first_per_source(_all_sources(spark, sf), ["source_id"], 20).select("ord", "source_id")


def item_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Item table written without its optional columns and scanned with schema and defaults; enabled sources only."""
    path_df = materialize(document_items(spark, sf).drop("unverified", "item_kind"), "raw-items")
    path = path_df.inputFiles()[0].rsplit("/", 1)[0]
    scanned = items.read_raw_items(spark, path)
    sources = table(spark, sf, "documents").select(F.col("source").alias("source_id")).distinct()
    enabled = items.enabled_sources(sources.withColumn("enabled", F.when(F.col("source_id") != "src3", F.col("source_id") != "src4")))
    kept = scanned.join(enabled, "source_id", "left_semi")
    return kept.groupBy("source_id", "item_kind", "unverified").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("snippet").cast("bigint")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_parse, feed_raw_items, feed_check, news_payload_items, post_payload_items, short_video_items, video_items, api_errors, embedded_topics,
        embedded_topics_known_path, forecast_payload, weighted_signal, demand_signals, source_union, source_caps, item_scan,
    )
}

_TITLE = "string_split(text, chr(10))[1]"
_UNION = f"""u as (select 0 as p, doc_id as a, 0 as b, source as source_id, 'news' as item_kind, false as unverified, length({_TITLE}) as title_chars, length(text) as snippet_chars from documents
          union all select 1, conv_id, turn, role, 'social', true, length(text), 0 from conversations
          union all select 2, page_id, 0, 'web', 'news', false, length(regexp_extract(html, '<title>(.*?)</title>', 1, 'si')), length(html) from pages),
        numbered as (select *, row_number() over (order by p, a, b) - 1 as ord from u)"""
_DOCS = f"""d as (select doc_id, lang, source, {_TITLE} as title, text from documents)"""
_TOPICS = f"""with p as (select page_id, url, {sql_strip_html("regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 'si'), '</script>', ' ', 'g')")} as body from pages where page_id % 10 <> 9)
        select page_id, cast(0 as int) as pos, 'page ' || page_id as title, 'https://pantip.com/topic/' || page_id as link, cast(1752546600 as bigint) as epoch, sha256(body) as snippet_sha, 'Pantip (tag cars)' as source_name from p
        union all select page_id, 1, 'comment only', case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' then regexp_replace(url, '^(https?://[^/?#]+)', '\\1/') else url end, 1752546600, sha256('hit'), 'Pantip (tag cars)' from p"""
_CITY = """rows as (select n_nationkey as o, n_name as city, n_regionkey + 1.0 as w, o_totalprice / 6000 as f, case when n_nationkey % 3 <> 0 then c_acctbal / 100 end as pm
          from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
        city as (select city, min(o) as o, any_value(w) as w, max(f) as peak, avg(f) as mean, max(pm) as pm from rows group by city)"""


def _dec(e: str) -> str:
    return f"regexp_replace(cast(cast(floor({e} * 10 + 0.5) / 10 as double) as varchar), '\\.0$', '')"


_FEED_TITLE = "regexp_replace(title, '[<>&\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')"
_FEED_BODY = "regexp_replace(text, '\\]\\]>|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')"

ORACLES = {
    "feed_parse": f"""with {_DOCS}, t as (select *, {sql_strip_html(_FEED_TITLE)} as st, {sql_strip_html(_FEED_BODY)} as sb from d where doc_id % 20 <> 19)
        select doc_id, 'https://feed.example.com/' || lang || '/' || doc_id as link, length(st) as title_chars, {sql_content_hash('st', 'sb', None)} as text_hash,
          cast(1752546600 as bigint) as epoch, case when doc_id % 3 = 0 then 'pub' end as publisher from t where st <> ''""",
    "feed_raw_items": f"""with {_DOCS}, t as (select *, cast(cast(substring(source, 4) as int) % 3 + 1 as int) as tier, {sql_strip_html(_FEED_TITLE)} as st, {sql_strip_html(_FEED_BODY)} as sb from d where doc_id % 20 <> 19)
        select 'feed' as kind, doc_id, source || case when doc_id % 3 = 0 then ' / pub' else '' end as source_name, tier as source_tier, tier = 3 as unverified, 'news' as item_kind, length(sb) as snippet_chars from t where st <> ''
        union all select 'search', doc_id, case when doc_id % 3 = 0 then 'pub' else 'search' end, cast(2 as int), false, 'news', length({sql_strip_html('sb')}) from t where st <> ''""",
    "feed_check": """select doc_id, doc_id % 20 <> 19 as ok, cast(case when doc_id % 20 <> 19 then 1 else 0 end as bigint) as entries,
          case when doc_id % 20 <> 19 then 'https://feed.example.com/' || lang || '/' || doc_id else '' end as sample,
          case when doc_id % 20 <> 19 then '' when doc_id % 3 = 0 then 'empty feed body' when doc_id % 3 = 1 then 'unrecognised feed format (no rss/rdf/atom root)' else 'malformed XML' end as error from documents""",
    "news_payload_items": f"""with {_DOCS}, t as (select *, {sql_strip_html('title')} as st, {sql_strip_html('text')} as sb from d where source <> 'src5')
        select doc_id, 'https://www.' || source || '.example.com/' || lang || '/' || doc_id || '?utm_source=x' as link, source as source_name, lang as language, cast(1752546600 as bigint) as epoch, {sql_content_hash('st', 'sb', None)} as text_hash from t""",
    "post_payload_items": f"""with t as (select *, {sql_strip_html('text')} as sb from conversations where role <> 'system')
        select conv_id, turn, case when turn % 2 = 0 then 'https://www.posts.example.com/p/' else 'https://www.facebook.com/' end || conv_id || '_' || turn as link, 'facebook:' || role as source_id,
          cast(1752546600 as bigint) as epoch, {sql_content_hash("''", 'sb', None)} as text_hash from t where sb <> ''""",
    "short_video_items": """select event_id, event_type || ' & ' || props as title, 'https://www.tiktok.com/video/' || event_id as link, 'tiktok:' || event_type as source_id, cast(floor(epoch(ts)) as bigint) as epoch from events""",
    "video_items": """with h as (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders where o_orderkey % 50 <> 49)
        select cast(o_custkey as varchar) as video_id, o_orderkey as query_ord, o_orderpriority as title, 'https://www.youtube.com/watch?v=' || o_custkey as link,
          o_orderstatus || ' (ช่อง: chan)' || ' · ยอดวิว ' || format('{:,}', views) || ' ครั้ง' as snippet,
          cast(epoch(o_orderdate) as bigint) as epoch from h join (select o_custkey, arg_max(cast(floor(o_totalprice) as bigint), o_orderkey) as views from orders group by 1) using (o_custkey) where rn = 1""",
    "api_errors": """select conv_id, turn, case when role = 'user' then 'user' else 'keyInvalid: m' end as error from conversations where role = 'user' or turn % 2 <> 0""",
    "embedded_topics": _TOPICS,
    "embedded_topics_known_path": _TOPICS,
    "forecast_payload": """with d as (select user_id, cast(ts as date) as d, max(value) as v, min(value) filter (event_type = 'view') as f from events group by all)
        select user_id, cast(d as varchar) as day, v as temp_max, coalesce(f, v) as feels_like, max(f) over (partition by user_id) as pm25 from d""",
    "weighted_signal": f"""with {_CITY} select city, round(peak, 6) as peak, round(mean, 6) as mean, (select round(cast(sum(mean * w) / sum(w) as double), 6) from city) as weighted,
          (select city from city order by peak desc, o limit 1) as hottest from city""",
    "demand_signals": f"""with {_CITY}, s as (select sum(mean * w) / sum(w) as feels, sum(pm * w) / sum(w) filter (pm is not null) as pm, max(peak) as hp, max(pm) as wp from city),
        x as (select *, (select city from city order by peak desc, o limit 1) as hot, (select city from city where city.pm is not null order by city.pm desc, o limit 1) as worst,
          (select string_agg(city || ' ' || {_dec('peak')} || '°C', ' · ' order by peak desc, o) from (select * from city order by peak desc, o limit 4)) as cl from s)
        select cast(0 as bigint) as ord, case when feels >= 40 then 'Severe heat' else 'Heat' end || ', 7 days ahead: felt maximum of ' || {_dec('feels')} || '°C on average' as title,
          'Felt maximum by city: ' || cl || '. Weighted average ' || {_dec('feels')} || '°C, highest in ' || hot || ' with ' || {_dec('hp')} || '°C. More cooling is used, so cooling systems need care sooner.' as snippet,
          'https://open-meteo.com/' as link, 'Open-Meteo forecast' as source_name, cast(1 as int) as source_tier, 'signal' as item_kind from x where feels >= 36
        union all select 1, case when pm >= 50 then 'Fine dust at an unhealthy level' else 'Fine dust above normal' end || ': PM2.5 maximum of ' || {_dec('pm')} || ' µg/m³ on average',
          'PM2.5 maximum ' || {_dec('pm')} || ' µg/m³ on average, highest in ' || worst || ' with ' || {_dec('wp')} || ' µg/m³. Cabin air gets attention, so filters and cleaning are asked for.',
          'https://open-meteo.com/en/docs/air-quality-api', 'Open-Meteo air quality', 1, 'signal' from x where pm >= 37.5""",
    "source_union": f"""with {_UNION} select ord, source_id, item_kind, unverified, title_chars, snippet_chars from numbered""",
    "source_caps": f"""with {_UNION} select ord, source_id from numbered qualify row_number() over (partition by source_id order by ord) <= 20""",
    "item_scan": """select source as source_id, 'news' as item_kind, false as unverified, count(*) as items, cast(sum(length(text)) as bigint) as chars from documents where source <> 'src4' group by source""",
}
