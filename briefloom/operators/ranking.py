"""Rankings and top-k (L1-L10). Sorted limits plan as a distributed top-k; ties go by ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.functions.numbers import clamp
from briefloom.functions.text import truncate
from briefloom.session import with_scalars


def significance() -> Column:
    """Publish weight: impact times confidence, plus relevance (L1)."""
    return F.abs("impact_score") * (F.col("confidence") / 100.0) + F.col("relevance_score") / 100.0


def publish_order() -> list[Column]:
    """Order of a published report; ties go by prefilter score, then ``ord``."""
    return [F.desc(significance()), F.desc("prefilter_score"), F.asc("ord")]


def publish_cut(df: DataFrame, min_relevance: int = 40) -> DataFrame:
    """Relevance cut."""
    return df.where(F.col("relevance_score") >= min_relevance)


def gate(df: DataFrame, min_score: int = 8) -> DataFrame:
    """Prefilter gate (F3). Runs after deduplication: a low-score row may still shape a group."""
    return df.where(F.col("prefilter_score") >= min_score)


def publish_ranking(df: DataFrame) -> DataFrame:
    return df.orderBy(*publish_order())


def top_by_class(df: DataFrame, classification: str, k: int = 3) -> DataFrame:
    """Strongest items of one verdict (L2)."""
    order = F.asc("impact_score") if classification == "negative" else F.desc("impact_score")
    return df.where(F.col("classification") == classification).orderBy(order, *publish_order()).limit(k)


def most_significant(df: DataFrame, k: int = 35) -> DataFrame:
    """Items worth a daily model pass (L3)."""
    return df.orderBy(F.desc(F.abs("impact_score") * F.col("confidence")), "ord").limit(k)


def candidate_preview(df: DataFrame, k: int = 10) -> DataFrame:
    """Best prefilter scores."""
    return df.orderBy(F.desc("prefilter_score"), "ord").limit(k)


def first_per_source(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First n rows per source in order (A17). The limit is pushed below the shuffle
    (WindowGroupLimit), so a source with very many rows sends only n per task."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def trend(index: DataFrame, days: int = 7) -> DataFrame:
    """Last index days, oldest first, score clamped to -5..5 with its tone (L7); empty below two days."""
    last = index.select("date", F.coalesce("net_impact_score", F.lit(0.0)).alias("net")).orderBy(F.desc("date")).limit(days)
    enough = last.agg((F.count(F.lit(1)) >= 2).alias("enough"))
    tone = F.when(F.col("net") >= 2, "pos").when(F.col("net") <= -2, "neg").otherwise("neu")
    return (
        with_scalars(last, enough)
        .where("enough")
        .select("date", clamp(F.col("net"), -5.0, 5.0).alias("score"), tone.alias("tone"))
        .orderBy("date")
    )


def compact_projection(df: DataFrame, summary_chars: int = 260) -> DataFrame:
    """The 14 columns a model pass reads."""
    return df.select(
        "id", "title_local", truncate(F.col("short_summary"), summary_chars).alias("summary"), "classification",
        "impact_score", "confidence", F.col("news_category").alias("category"), F.col("affected_channels").alias("channels"),
        F.col("affected_products").alias("products"), F.col("affected_countries").alias("countries"),
        F.col("affected_competitors").alias("competitors"), F.col("okr_impact").alias("okr"),
        F.col("source_name").alias("source"), F.col("source_tier").alias("tier"),
    )


def action_items(actions: DataFrame, items: DataFrame, per_action: int = 2) -> DataFrame:
    """Items an action refers to (D10): first ids of its list, unknown ids dropped."""
    refs = actions.select("action_ord", "action", F.posexplode("related_ids").alias("pos", "id")).where(F.col("pos") < per_action)
    return refs.join(items.select("id", "title_local", "canonical_url"), "id")
