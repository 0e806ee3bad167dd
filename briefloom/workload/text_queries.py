"""Queries for text, URL, hash, date and number functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.functions import dates, hashing, numbers, text, urls
from briefloom.operators.robots import allowed_by_robots, robots_rules
from briefloom.workload.inputs import document_items, now, table

# The white space and non-word classes of the library, in RE2 syntax.
SQL_WS = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
SQL_NOT_WORD = "[^\\p{L}\\p{N}\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SQL_WS}+', ' ', 'g'))"


def sql_norm(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '{SQL_NOT_WORD}', ' ', 'g')"


def sql_content_hash(title: str, body: str, chars: int | None) -> str:
    norm = sql_collapse(sql_norm(body))
    norm = norm if chars is None else f"substring({norm}, 1, {chars})"
    return f"substring(sha256({sql_collapse(sql_norm(title))} || '|' || {norm}), 1, 24)"


SQL_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def sql_tokens(expr: str) -> str:
    words = f"regexp_split_to_array({sql_norm(expr)}, '{SQL_WS}+')"
    return f"list_filter({words}, lambda w: length(w) > 1 and not list_contains({SQL_STOP}, w))"


def sql_token_set(expr: str) -> str:
    return f"list_distinct({sql_tokens(expr)})"


def sql_packed(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '{SQL_WS}+', '', 'g')"


def sql_trigrams(packed: str) -> str:
    """Distinct slices of a column that holds packed text."""
    return f"list_distinct(list_transform(range(1, length({packed}) - 1), lambda i: {packed}[i:i+2]))"


def sql_strip_html(expr: str) -> str:
    out = f"regexp_replace({expr}, '<!--.*?-->', ' ', 'gs')"
    for tag in text.OPAQUE_ELEMENTS:
        out = f"regexp_replace({out}, '<{tag}\\b.*?</{tag}\\s*>', ' ', 'gsi')"
    out = f"regexp_replace({out}, '<(?:{'|'.join(text.OPAQUE_ELEMENTS)})\\b.*', ' ', 'gsi')"
    out = f"regexp_replace({out}, '<br\\s*/?>|</p>', ' ', 'gi')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    names = [n for n in text.NAMED_ENTITIES if n != "amp"] + ["amp"]
    for name in names:
        value = text.NAMED_ENTITIES[name].replace("'", "''")
        out = f"regexp_replace({out}, '&{name};', '{value}', 'gi')"
    out = f"regexp_replace({out}, '[\\x00-\\x1F\\x7F-\\x{{9F}}]', ' ', 'g')"
    return sql_collapse(out)


SQL_CANONICAL = """
parts as (
  select *, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host,
         case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/'
              else regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) end as path,
         list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '') as params
  from {src}
),
canon as (
  select *, 'https://' || regexp_replace(regexp_replace(host, '^www\\.', '') || path, '([^/])/$', '\\1')
    || case when len(kept) = 0 then '' else '?' || list_aggregate(kept, 'string_agg', '&') end as canonical_url
  from (select *, list_sort(list_filter(params, lambda p: not regexp_matches(lower(string_split(p, '=')[1]),
      '^utm_|^(fbclid|gclid|dclid|msclkid|igshid|mc_cid|mc_eid|ref|ref_src|referrer|source|cmpid|campaign_id|spm|_ga|yclid|oc)$'))) as kept
    from parts)
)
"""


def url_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    pages = urls.with_sanitized_url(urls.with_canonical_url(table(spark, sf, "pages"), "url"), "url", "safe_url")
    return pages.select(
        "page_id", "canonical_url", "safe_url",
        urls.domain_of(F.col("url")).alias("domain"),
        hashing.id_from_url(F.col("canonical_url")).alias("id"),
        text.has_control_or_space(F.col("url")).alias("unclean_url"),
        text.has_control_or_space(F.col("html")).alias("unclean_html"),
    )


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.withColumns({"title": text.strip_html(title), "body": text.strip_html(F.col("html"))})


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return page_texts(spark, sf).select(
        "page_id",
        text.truncate(F.col("title"), 40).alias("short_title"),
        F.length("body").cast("bigint").alias("chars"),
        hashing.sha256(F.col("body")).alias("text_sha"),
    )


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    title = F.substring_index("text", "\n", 1)
    return d.select(
        "doc_id",
        hashing.content_hash(title, F.col("text")).alias("content_hash"),
    )


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.size(text.tokenize(F.col("text"))).cast("bigint").alias("tokens"),
        F.size(text.token_set(F.col("text"))).cast("bigint").alias("distinct_tokens"),
        F.size(text.trigrams(F.col("text"))).cast("bigint").alias("trigrams"),
    )


def turn_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each turn with the next one of its conversation: shingles once per turn, then an equi-join."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", text.token_set(F.col("text")).alias("tok"), text.trigrams(F.col("text")).alias("tri")
    )
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tok").alias("tok2"), F.col("tri").alias("tri2"))
    tok = text.jaccard(F.col("tok"), F.col("tok2"))
    tri = text.jaccard(F.col("tri"), F.col("tri2"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(tok, 6).alias("token_jaccard"), F.round(tri, 6).alias("trigram_jaccard"),
        F.round(F.greatest(tok, tri), 6).alias("similarity"),
    )


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written out in four notations and read back."""
    o = table(spark, sf, "orders")
    thai = F.array(*[F.lit(m) for m in dates.THAI_MONTHS if "." not in m])
    day, month, year = F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")
    style = F.col("o_orderkey") % 4
    written = (
        F.when(style == 0, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(style == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+07:00'"))
        .when(style == 2, F.concat_ws(" ", day.cast("string"), F.element_at(thai, month), (year + 543).cast("string")))
        .otherwise(F.concat_ws("/", day.cast("string"), month.cast("string"), year.cast("string")))
    )
    clock = F.lit("1999-06-01T00:00:00Z").cast("timestamp")
    ts = dates.parse_date(written)
    return o.select("o_orderkey", ts.alias("ts"), dates.clamp_date(ts, clock).alias("clamped")).select(
        "o_orderkey",
        F.unix_seconds("ts").alias("epoch"),
        dates.date_key(F.col("ts")).cast("string").alias("local_day"),
        dates.format_local(F.col("ts"), pattern="yyyy-MM-dd HH:mm").alias("local_time"),
        F.col("clamped").isNull().alias("absurd"),
    )


def epoch_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch seconds and ISO text mixed in one column, and the look-back test."""
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.unix_seconds("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = dates.parse_epoch_or_date(raw)
    clock = F.lit("2024-01-15T12:00:00Z").cast("timestamp")
    return e.select(
        "event_id",
        F.unix_seconds(parsed).alias("epoch"),
        dates.is_within_lookback(F.col("ts"), 48, clock).alias("within"),
    )


def number_rounding(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l_extendedprice") * F.col("l_discount") - F.lit(2500.0)
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(numbers.round_int(x).cast("bigint")).alias("rounded"),
        F.sum(numbers.trunc(x).cast("bigint")).alias("truncated"),
        F.sum(numbers.round_int(numbers.clamp(x, -500.0, 500.0)).cast("bigint")).alias("clamped"),
        F.round(F.sum(numbers.round1(F.col("l_quantity") / 7)), 1).alias("tenths"),
    )


def robots_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Robots files derived from the pages' own origins; blocks one language path per origin."""
    pages = urls.with_sanitized_url(table(spark, sf, "pages"), "url", "safe_url")
    origins = pages.select(urls.origin_of(F.col("safe_url")).alias("origin")).distinct()
    size = F.length("origin") % 4
    body = F.concat(
        F.lit("User-agent: otherbot\nDisallow: /\nUser-agent: *  # all\nAllow: /x\n"),
        F.when(size == 0, "Disallow: /en").when(size == 1, "Disallow: /fr/\nDisallow:\n").when(size == 2, "disallow:/de/4\r\n").otherwise("# none"),
    )
    rules = robots_rules(origins.select("origin", body.alias("body")), "newsreader/1.0")
    return allowed_by_robots(pages, rules, "safe_url", "page_id").select("page_id", "safe_url")


def domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to canonical links, best copy per link, pages and text per domain."""
    from briefloom.operators.dedup import keep_best, shorter, sort_code

    pages = urls.with_canonical_url(page_texts(spark, sf), "url")
    narrow = pages.select(F.col("page_id").alias("ord"), "canonical_url", "title", F.length("body").cast("bigint").alias("chars"))
    best = keep_best(narrow, "canonical_url", sort_code((shorter(F.col("chars")), 10), (F.col("ord"), 19)))
    return best.groupBy(urls.domain_of(F.col("canonical_url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("stories"),
        F.sum("copies").alias("pages"),
        F.sum("chars").alias("chars"),
        F.countDistinct("title").alias("titles"),
    )


def source_groups(spark: SparkSession, sf: str) -> DataFrame:
    items = document_items(spark, sf)
    group = text.source_group(F.col("source_id"), F.col("source_name"), {"src3": "Video"}, {"src1": "Forum"})
    return items.groupBy(group.alias("source_group")).agg(F.count(F.lit(1)).alias("items"))


_TITLE = "string_split(text, chr(10))[1]"

QUERIES = {
    f.__name__: f
    for f in (
        url_canonicalize, html_to_text, content_hash, token_stats, turn_similarity, parse_dates, epoch_dates,
        number_rounding, robots_filter, domain_counts, source_groups,
    )
}

_SAFE = """case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = ''
       then regexp_replace(url, '^(https?://[^/?#]+)', '\\1/') else url end"""
_PAGE_BODY = sql_strip_html("html")
_PAGE_TITLE = sql_strip_html("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si')")

ORACLES = {
    "url_canonicalize": f"""with {SQL_CANONICAL.format(src='pages')}
        select page_id, canonical_url, {_SAFE} as safe_url, regexp_replace(host, '^www\\.', '') as domain,
               substring(sha256(canonical_url), 1, 16) as id, regexp_matches(url, '[\\x00-\\x20\\x7F]') as unclean_url, regexp_matches(html, '[\\x00-\\x20\\x7F]') as unclean_html from canon""",
    "html_to_text": f"""with t as (select page_id, {_PAGE_TITLE} as title, {_PAGE_BODY} as body from pages)
        select page_id, case when length(title) <= 40 then title else rtrim(substring(title, 1, 39)) || '…' end as short_title,
               length(body) as chars, sha256(body) as text_sha from t""",
    "content_hash": f"""select doc_id, {sql_content_hash(_TITLE, 'text', None)} as content_hash from documents""",
    "token_stats": f"""with w as (select doc_id, {sql_tokens('text')} as toks, {sql_packed('text')} as packed from documents),
        g as (select doc_id, count(distinct substring(packed, i, 3)) as trigrams
              from (select doc_id, packed, unnest(range(1, length(packed) - 1)) as i from w) group by doc_id)
        select w.doc_id, len(toks) as tokens, len(list_distinct(toks)) as distinct_tokens, coalesce(trigrams, 0) as trigrams
        from w left join g using (doc_id)""",
    "turn_similarity": f"""with p as materialized (select conv_id, turn, {sql_token_set('text')} as tok, {sql_packed('text')} as packed from conversations),
        s as materialized (select conv_id, turn, tok, {sql_trigrams('packed')} as tri from p),
        j as (select a.conv_id, a.turn,
            case when len(a.tok) = 0 or len(b.tok) = 0 then 0.0 else len(list_intersect(a.tok, b.tok)) / (len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok))) end as tj,
            case when len(a.tri) = 0 or len(b.tri) = 0 then 0.0 else len(list_intersect(a.tri, b.tri)) / (len(a.tri) + len(b.tri) - len(list_intersect(a.tri, b.tri))) end as gj
          from s a join s b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
        select conv_id, turn, round(tj, 6) as token_jaccard, round(gj, 6) as trigram_jaccard, round(greatest(tj, gj), 6) as similarity from j""",
    "parse_dates": """with t as (select o_orderkey, case o_orderkey % 4 when 0 then o_orderdate
          else date_trunc(case o_orderkey % 4 when 1 then 'second' else 'day' end, o_orderdate) - interval 7 hour end as ts from orders)
        select o_orderkey, cast(epoch(ts) as bigint) as epoch, cast(cast(ts + interval 7 hour as date) as varchar) as local_day,
               strftime(ts + interval 7 hour, '%Y-%m-%d %H:%M') as local_time,
               not (ts between timestamp '2000-01-01' and timestamp '1999-06-03') as absurd from t""",
    "epoch_dates": """select event_id, cast(floor(epoch(ts)) as bigint) as epoch,
        (timestamp '2024-01-15 12:00:00' - ts <= interval 48 hour and ts <= timestamp '2024-01-15 18:00:00') as within from events""",
    "number_rounding": """with t as (select *, l_extendedprice * l_discount - 2500.0 as x from lineitem)
        select l_returnflag, l_linestatus, cast(sum(floor(x + 0.5)) as bigint) as rounded, cast(sum(trunc(x)) as bigint) as truncated,
          cast(sum(floor(least(500.0, greatest(-500.0, x)) + 0.5)) as bigint) as clamped,
          round(sum(floor(l_quantity / 7 * 10 + 0.5) / 10), 1) as tenths
        from t group by all""",
    "robots_filter": f"""with s as (select page_id, {_SAFE} as safe_url from pages),
        o as (select *, regexp_extract(safe_url, '^(https?://[^/?#]*)', 1) as origin, regexp_extract(safe_url, '^https?://[^/?#]*([^#]*)', 1) as path from s)
        select page_id, safe_url from o where not (case length(origin) % 4 when 0 then starts_with(path, '/en')
          when 1 then starts_with(path, '/fr/') when 2 then starts_with(path, '/de/4') else false end)""",
    "domain_counts": f"""with {SQL_CANONICAL.format(src='pages')},
        t as (select page_id, canonical_url, {_PAGE_TITLE} as title, {_PAGE_BODY} as body from canon),
        r as (select *, row_number() over (partition by canonical_url order by length(body) desc, page_id) as rn,
                     count(*) over (partition by canonical_url) as copies from t)
        select regexp_extract(canonical_url, '^https://([^/?]*)', 1) as domain, count(*) as stories, cast(sum(copies) as bigint) as pages,
               cast(sum(length(body)) as bigint) as chars, count(distinct title) as titles from r where rn = 1 group by 1""",
    "source_groups": """select case when source = 'src3' then 'Video' when starts_with(source, 'src1') then 'Forum' else source end as source_group,
        count(*) as items from documents group by 1""",
}
