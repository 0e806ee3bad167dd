"""KPI roll-ups, scores, tallies and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.numbers import round2
from briefloom.functions.text import blank_to_null
from briefloom.session import with_scalars

FUNNEL = ("total_collected", "after_dedup", "after_prefilter")


def _has(channel: str) -> Column:
    return F.array_contains("affected_channels", channel)


def kpi_aggregates(international: Column) -> list[Column]:
    """The counters computed from items; null comparisons count as no."""
    positive = F.col("classification") == "positive"
    return [
        F.count(F.lit(1)).alias("published"),
        F.count_if(positive).alias("positive"),
        F.count_if(F.col("classification") == "neutral").alias("neutral"),
        F.count_if(F.col("classification") == "negative").alias("negative"),
        F.count_if(F.abs("impact_score") >= 3).alias("high_impact"),
        F.count_if(F.size("affected_competitors") > 0).alias("competitor_alerts"),
        F.count_if(F.col("news_category") == "EV").alias("ev_related"),
        F.count_if(international).alias("international"),
        F.count_if(_has("OEM") & positive).alias("oem_opportunities"),
        F.count_if(_has("B2B") & positive).alias("b2b_opportunities"),
        F.count_if(_has("B2C") & positive).alias("b2c_opportunities"),
        F.count_if(F.col("okr_impact.O1") == "positive").alias("o1_supporting"),
        F.count_if(F.col("okr_impact.O2") == "positive").alias("o2_supporting"),
        F.count_if(F.col("item_kind") == "social").alias("social_mentions"),
        F.count_if(F.col("item_kind") == "signal").alias("demand_signals"),
    ]


def daily_international(home: str = "TH", home_name: str = "Thailand") -> Column:
    """Daily definition: neither the home country's name in the text nor a home source."""
    return ~F.array_contains("affected_countries", home_name) & (F.col("source_country") != home)


def range_international(home: str = "TH") -> Column:
    """Range definition: source outside the home country."""
    return ~F.col("source_country").eqNullSafe(F.lit(home))


def daily_kpi(items: DataFrame, by: tuple[str, ...] = (), funnel: DataFrame | None = None) -> DataFrame:
    """18 counters in one pass (K1). ``funnel`` is a one-row table (or one row per ``by``) of stage counts."""
    kpi = items.groupBy(*by).agg(*kpi_aggregates(daily_international()))
    if funnel is None:
        return kpi
    counts = funnel.select(*by, *FUNNEL)
    return kpi.join(counts, list(by)) if by else with_scalars(kpi, counts)


def range_kpi(items: DataFrame, day_kpis: DataFrame) -> DataFrame:
    """Funnel counters summed over the days, all others recomputed on the merged items (K2)."""
    sums = day_kpis.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FUNNEL])
    return with_scalars(items.agg(*kpi_aggregates(range_international())), sums)


def sentiment_of(net: Column) -> Column:
    return F.when(net >= 3, "positive").when(net <= -3, "negative").otherwise("neutral")


def urgency_of(net: Column, competitor_items: Column) -> Column:
    return F.when((F.abs(net) >= 6) | (competitor_items >= 3), "high").when(F.abs(net) >= 3, "medium").otherwise("low")


def net_score(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Confidence-weighted net score, sentiment and urgency (K3). Both verdicts use the unrounded score."""
    agg = items.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("impact_score") * (F.col("confidence") / 100.0)), F.lit(0.0)).alias("net"),
        F.count_if(F.size("affected_competitors") > 0).alias("competitor_items"),
    )
    return agg.withColumns(
        {
            "net_impact_score": F.round("net", 2),
            "overall_sentiment": sentiment_of(F.col("net")),
            "urgency_level": urgency_of(F.col("net"), F.col("competitor_items")),
        }
    )


def range_net(items: DataFrame) -> DataFrame:
    """Plain mean impact and majority sentiment of merged items (K4)."""
    agg = items.agg(
        F.avg(F.coalesce("impact_score", F.lit(0))).alias("mean"),
        F.count_if(F.col("classification") == "positive").alias("pos"),
        F.count_if(F.col("classification") == "negative").alias("neg"),
    )
    return agg.select(
        F.coalesce(round2(F.col("mean")), F.lit(0.0)).alias("net_impact_score"),
        F.when(F.col("pos") > F.col("neg"), "positive")
        .when(F.col("neg") > F.col("pos"), "negative")
        .otherwise("neutral")
        .alias("overall_sentiment"),
    )


def worst_status(statuses: DataFrame, by: tuple[str, ...] = (), status: str = "status") -> DataFrame:
    """failed before degraded before ok (K5)."""
    severity = F.when(F.col(status) == "failed", 2).when(F.col(status) == "degraded", 1).otherwise(0)
    worst = statuses.groupBy(*by).agg(F.max(severity).alias("s"))
    label = F.when(F.col("s") == 2, "failed").when(F.col("s") == 1, "degraded").otherwise("ok")
    return worst.select(*by, label.alias("status"))


def run_status(health: DataFrame, errors: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Status of a run from its source health and error log (K6).

    Sources that are not configured do not count (F9). ``errors`` is only read for its row count,
    per ``by`` group if there is one.
    """
    configured = F.coalesce("configured", F.lit(True))
    agg = health.groupBy(*by).agg(
        F.count_if(configured).alias("sources"),
        F.count_if(configured & ~F.col("ok")).alias("failed"),
    )
    if errors is None:
        agg = agg.withColumn("errors", F.lit(0))
    else:
        counts = errors.groupBy(*by).agg(F.count(F.lit(1)).alias("errors"))
        agg = agg.join(counts, list(by), "left") if by else with_scalars(agg, counts)
    status = (
        F.when((F.col("sources") > 0) & (F.col("failed") == F.col("sources")), "failed")
        .when((F.col("failed") > 0) | (F.coalesce("errors", F.lit(0)) > 0), "degraded")
        .otherwise("ok")
    )
    return agg.withColumn("status", status)


def source_health(fetches: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Health per source (K7): ok with one good fetch, item count, failure ratio.

    ``fetches``: source_id, ok, error, ord. ``items``: source_id. ``sources``: source_id, source_name.
    Sources without fetches or items still get a row.
    """
    calls = fetches.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("ok").alias("good"),
        F.max_by("error", F.when(~F.col("ok"), F.col("ord"))).alias("last_error"),
    )
    counts = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("item_count"))
    joined = sources.join(calls, "source_id", "left").join(counts, "source_id", "left")
    failed = F.col("calls") - F.col("good")
    note = F.concat(
        failed.cast("string"), F.lit("/"), F.col("calls").cast("string"), F.lit(" queries failed (last: "),
        F.coalesce("last_error", F.lit("")), F.lit(")"),
    )
    return joined.select(
        "source_id",
        "source_name",
        F.coalesce(F.col("good") > 0, F.lit(False)).alias("ok"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.when(failed > 0, note).alias("error"),
    )


def tally(df: DataFrame, values: Column, limit: int = 8, multi: bool = False) -> DataFrame:
    """Most frequent labels (K8); empty ones are skipped, ties go by label."""
    listed = df.select((F.explode(values) if multi else values).alias("label"))
    counted = listed.select(F.col("label").cast("string")).where(blank_to_null(F.col("label")).isNotNull())
    counts = counted.groupBy("label").agg(F.count(F.lit(1)).alias("value"))
    return counts.orderBy(F.desc("value"), "label").limit(limit)


def facet_values(df: DataFrame, values: Column, multi: bool = False) -> DataFrame:
    """Distinct non-empty values in order (K9)."""
    listed = df.select((F.explode(values) if multi else values).alias("value"))
    return listed.select(F.col("value").cast("string")).where(F.coalesce("value", F.lit("")) != "").distinct().orderBy("value")


def weighted_average(value: Column, weight: Column) -> Column:
    """Aggregate expression; 0 when the weights sum to 0."""
    return F.coalesce(F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def distinct_flat(df: DataFrame, column: str, where: Column) -> DataFrame:
    """Distinct entries of a list column over the rows that qualify, sorted."""
    return df.where(where).select(F.explode(column).alias("value")).distinct().orderBy("value")


def model_stats(items: DataFrame) -> DataFrame:
    """Counters handed to the daily model pass."""
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in ("positive", "neutral", "negative")],
        F.count_if(F.size("affected_competitors") > 0).alias("competitor_mentions"),
    )


def feed_check(parsed: DataFrame, errors: DataFrame, feeds: DataFrame) -> DataFrame:
    """Per feed: ok, entry count, first title, error; failed ones first."""
    counts = parsed.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("entries"), F.min_by("title", "entry_pos").alias("sample")
    )
    bad = errors.groupBy("source_id").agg(F.min("error").alias("error"))
    joined = feeds.select("source_id").distinct().join(counts, "source_id", "left").join(bad, "source_id", "left")
    return joined.select(
        "source_id",
        F.col("error").isNull().alias("ok"),
        F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce("sample", F.lit("")).alias("sample"),
        F.coalesce("error", F.lit("")).alias("error"),
    ).orderBy("ok", "source_id")


def error_log(errors: DataFrame, limit: int | None = None) -> DataFrame:
    """Errors in order, with ``limit`` the first ones, as ``[scope] message``."""
    text = F.concat(F.lit("["), F.col("scope"), F.lit("] "), F.col("message"))
    log = errors.select("ord", "scope", text.alias("error")).orderBy("ord")
    return log if limit is None else log.limit(limit)


def range_errors(errors: DataFrame) -> DataFrame:
    """Errors of several days, newest day first."""
    return errors.orderBy(F.desc("date"), "ord")
