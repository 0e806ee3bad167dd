"""JSON API payload tables to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.dates import parse_date
from briefloom.functions.text import api_error_reason, blank_to_null, build_video_snippet, strip_html, truncate
from briefloom.functions.urls import with_sanitized_url
from briefloom.session import compute_once

NEWS_SCHEMA = (
    "status string, articles array<struct<title: string, url: string, description: string, publishedAt: string, "
    "source: struct<name: string>>>"
)
POSTS_SCHEMA = (
    "data array<struct<id: string, message: string, created_time: string, permalink_url: string>>, error struct<message: string>"
)
SHORTS_SCHEMA = "data struct<videos: array<struct<id: string, video_description: string, create_time: bigint>>>"
VIDEO_SCHEMA = (
    "items array<struct<id: struct<videoId: string>, snippet: struct<title: string, description: string, "
    "channelTitle: string, publishedAt: string>>>"
)
VIDEO_STATS_SCHEMA = "items array<struct<id: string, statistics: struct<viewCount: string>>>"
FORECAST_SCHEMA = (
    "daily struct<time: array<string>, temperature_2m_max: array<double>, apparent_temperature_max: array<double>>"
)
AIR_SCHEMA = "hourly struct<pm2_5: array<double>>"


def _rest(df: DataFrame, *used: str) -> list[str]:
    return [c for c in df.columns if c not in used]


def _social(tier: int = 3) -> dict[str, Column]:
    return {
        "source_tier": F.lit(tier),
        "source_country": F.lit("TH"),
        "language": F.lit("th"),
        "unverified": F.lit(True),
        "item_kind": F.lit("social"),
    }


def news_api_items(payloads: DataFrame, body: str = "body", max_snippet_chars: int | None = None) -> DataFrame:
    """News-search payloads (A5): good ones only, articles with title and link only.

    ``language`` is that of the query a payload answers, a column of ``payloads``; null without one.
    """
    keep = _rest(payloads, body)
    if "language" not in keep:
        payloads, keep = payloads.withColumn("language", F.lit(None).cast("string")), [*keep, "language"]
    parsed = payloads.select(*keep, F.from_json(F.col(body), NEWS_SCHEMA).alias("p")).where(F.col("p.status") == "ok")
    rows = parsed.select(*keep, F.posexplode("p.articles").alias("entry_pos", "a"))
    return rows.where(F.coalesce(F.col("a.title"), F.lit("")) != "").where(F.coalesce(F.col("a.url"), F.lit("")) != "").select(
        *keep,
        "entry_pos",
        strip_html(F.col("a.title")).alias("title"),
        F.col("a.url").alias("link"),
        truncate(strip_html(F.col("a.description")), max_snippet_chars).alias("snippet"),
        parse_date(F.col("a.publishedAt")).alias("published_at"),
        F.lit("newsapi").alias("source_id"),
        F.coalesce("a.source.name", F.lit("NewsAPI")).alias("source_name"),
        F.lit(2).alias("source_tier"),
        F.lit("GLOBAL").alias("source_country"),
        F.lit(False).alias("unverified"),
        F.lit("news").alias("item_kind"),
    )


def post_items(
    payloads: DataFrame, body: str = "body", max_title_chars: int | None = None, max_snippet_chars: int | None = None
) -> DataFrame:
    """Page-post payloads (A6); needs page_id. A payload-level error rejects the document."""
    keep = _rest(payloads, body)
    parsed = payloads.select(*keep, F.from_json(F.col(body), POSTS_SCHEMA).alias("p")).where(F.col("p.error").isNull())
    rows = compute_once(
        parsed.select(*keep, F.posexplode("p.data").alias("entry_pos", "d")),
        {
            "text": strip_html(F.col("d.message")),
            "__link": F.coalesce("d.permalink_url", F.concat(F.lit("https://www.facebook.com/"), F.col("d.id"))),
            "__time": F.col("d.created_time"),
        },
    )
    linked = with_sanitized_url(rows.where(F.col("text") != ""), "__link", "link")
    return linked.select(
        *keep,
        "entry_pos",
        truncate(F.col("text"), max_title_chars).alias("title"),
        "link",
        truncate(F.col("text"), max_snippet_chars).alias("snippet"),
        parse_date(F.col("__time")).alias("published_at"),
        F.concat(F.lit("facebook:"), F.col("page_id")).alias("source_id"),
        F.concat(F.lit("Facebook ("), F.col("page_id"), F.lit(")")).alias("source_name"),
        *[v.alias(k) for k, v in _social().items()],
    )


def short_video_items(
    payloads: DataFrame, body: str = "body", max_title_chars: int | None = None, max_snippet_chars: int | None = None
) -> DataFrame:
    """Short-video payloads (A7); needs hashtag. Times are epoch seconds, links come from ids."""
    keep = _rest(payloads, body)
    parsed = payloads.select(*keep, F.from_json(F.col(body), SHORTS_SCHEMA).alias("p"))
    rows = compute_once(
        parsed.select(*keep, F.posexplode("p.data.videos").alias("entry_pos", "v")),
        {
            "text": strip_html(F.col("v.video_description")),
            "__link": F.concat(F.lit("https://www.tiktok.com/video/"), F.col("v.id")),
            "__time": F.nullif("v.create_time", F.lit(0)),
        },
    )
    linked = with_sanitized_url(rows.where(F.col("text") != ""), "__link", "link")
    return linked.select(
        *keep,
        "entry_pos",
        truncate(F.col("text"), max_title_chars).alias("title"),
        "link",
        truncate(F.col("text"), max_snippet_chars).alias("snippet"),
        F.timestamp_seconds("__time").alias("published_at"),
        F.concat(F.lit("tiktok:"), F.col("hashtag")).alias("source_id"),
        F.concat(F.lit("TikTok (#"), F.col("hashtag"), F.lit(")")).alias("source_name"),
        *[v.alias(k) for k, v in _social().items()],
    )


def api_errors(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Payloads that report an error, with its reason."""
    return payloads.withColumn("error", api_error_reason(F.col(body))).where(F.col("error").isNotNull()).drop(body)


def video_stats(payloads: DataFrame, body: str = "body", ord: str = "ord") -> DataFrame:
    """View counts per video (D9): the last payload row of a video wins, in the order of ``ord``."""
    good = payloads.where(api_error_reason(F.col(body)).isNull())
    listed = good.select(F.col(ord).alias("__ord"), F.posexplode(F.from_json(F.col(body), VIDEO_STATS_SCHEMA)["items"]).alias("__pos", "i"))
    rows = listed.select("__ord", "__pos", "i.*")
    counted = rows.where(F.col("id").isNotNull() & F.col("statistics.viewCount").isNotNull())
    views = F.coalesce(F.expr("try_cast(statistics.viewCount AS bigint)"), F.lit(0))
    return counted.groupBy(F.col("id").alias("video_id")).agg(F.max_by(views, F.struct("__ord", "__pos")).alias("views"))


def video_items(
    payloads: DataFrame, stats: DataFrame, body: str = "body", ord: str = "ord",
    max_title_chars: int | None = None, max_snippet_chars: int | None = None,
) -> DataFrame:
    """Video-search payloads (A8): the first hit of a video over all queries wins, view counts joined on.

    ``payloads`` has ``ord`` (query order) and the body; ``stats`` comes from ``video_stats``.
    """
    from briefloom.operators.dedup import first_by

    good = payloads.where(api_error_reason(F.col(body)).isNull())
    hits = good.select(F.col(ord).alias("query_ord"), F.posexplode(F.from_json(F.col(body), VIDEO_SCHEMA)["items"]).alias("pos", "i"))
    rows = hits.where(F.coalesce(F.col("i.id.videoId"), F.lit("")) != "").select(
        "query_ord",
        "pos",
        F.col("i.id.videoId").alias("video_id"),
        F.col("i.snippet.title").alias("raw_title"),
        F.col("i.snippet.description").alias("raw_description"),
        F.col("i.snippet.channelTitle").alias("raw_channel"),
        F.col("i.snippet.publishedAt").alias("raw_time"),
    )
    first = first_by(rows, [F.col("video_id")], F.struct("query_ord", "pos"))
    cleaned = compute_once(
        first.join(stats, "video_id", "left"),
        {
            "title": strip_html(F.col("raw_title")),
            "channel": strip_html(F.col("raw_channel")),
            "__link": F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("video_id")),
        },
    )
    linked = with_sanitized_url(cleaned.where(F.col("title") != ""), "__link", "link")
    return linked.select(
        "query_ord",
        "pos",
        "video_id",
        truncate(F.col("title"), max_title_chars).alias("title"),
        "link",
        build_video_snippet(strip_html(F.col("raw_description")), F.col("channel"), F.col("views"), max_snippet_chars).alias("snippet"),
        parse_date(F.col("raw_time")).alias("published_at"),
        F.lit("youtube").alias("source_id"),
        F.concat(F.lit("YouTube · "), F.coalesce(blank_to_null(F.col("channel")), F.lit("ไม่ทราบช่อง"))).alias("source_name"),
        *[v.alias(k) for k, v in _social().items()],
    )


def forecast_days(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Forecast payloads with parallel lists to one row per day (A11); the felt value falls back to the maximum."""
    keep = _rest(payloads, body)
    daily = F.from_json(F.col(body), FORECAST_SCHEMA)["daily"]
    rows = payloads.select(*keep, daily.alias("d")).select(
        *keep,
        F.inline(
            F.arrays_zip(
                F.col("d.time").alias("day"),
                F.col("d.temperature_2m_max").alias("temp_max"),
                F.coalesce("d.apparent_temperature_max", F.array().cast("array<double>")).alias("feels"),
            )
        ),
    )
    finite = F.col("temp_max").isNotNull() & ~F.isnan("temp_max") & (F.abs("temp_max") != F.lit(float("inf")))
    return rows.where(F.col("day").isNotNull() & finite).select(
        *keep, "day", "temp_max", F.coalesce("feels", "temp_max").alias("feels_like")
    )


def hourly_max(payloads: DataFrame, body: str = "body", out: str = "pm25") -> DataFrame:
    """Largest finite value of the hourly list, null if there is none."""
    values = F.from_json(F.col(body), AIR_SCHEMA)["hourly"]["pm2_5"]
    finite = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return payloads.select(*_rest(payloads, body), F.array_max(finite).alias(out))
