"""Date ranges over stored reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.operators.graph import connected, salted_lookup
from briefloom.session import materialize, with_scalars


@dataclass(frozen=True)
class RangePreset:
    """``latest``, the last n report days (``last``), or a custom range with either bound order."""

    kind: str = "latest"
    days: int = 1
    start: date | None = None
    end: date | None = None


def dates_in_range(index: DataFrame, start: date, end: date) -> DataFrame:
    """Report dates from start to end, both included, newest first."""
    return index.select("date").where(F.col("date").between(F.lit(start), F.lit(end))).distinct().orderBy(F.desc("date"))


def resolve_range(index: DataFrame, preset: RangePreset) -> DataFrame:
    """Report dates a preset stands for (F8). An empty custom range falls back to the latest report."""
    days = index.select("date").distinct()
    latest = days.orderBy(F.desc("date")).limit(1)
    if preset.kind == "last":
        return days.orderBy(F.desc("date")).limit(max(1, preset.days))
    if preset.kind != "custom" or preset.start is None or preset.end is None:
        return latest
    low, high = sorted((preset.start, preset.end))
    picked = days.where(F.col("date").between(F.lit(low), F.lit(high)))
    inside = picked.agg(F.count(F.lit(1)).alias("n"))
    fallback = with_scalars(latest, inside).where(F.col("n") == 0).select("date")
    return picked.unionByName(fallback).orderBy(F.desc("date"))


def in_dates(reports: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of the chosen days; dates without a report simply return nothing."""
    return reports.join(F.broadcast(dates.select("date")), "date", "left_semi")


def _keys() -> Column:
    digest, url = F.nullif("content_hash", F.lit("")), F.nullif("canonical_url", F.lit(""))
    return F.array_compact(
        F.array(
            F.concat(F.lit("h:"), digest),
            F.concat(F.lit("u:"), url),
            F.when(digest.isNull() & url.isNull(), F.concat(F.lit("i:"), F.col("id"))),
        )
    )


def merge_groups(items: DataFrame) -> DataFrame:
    """Group head of every item over several days: (ord, first_ord).

    ``ord`` rises from the newest report to the oldest. An item belongs to the earliest group it
    reaches through equal fingerprints or URLs. Items are linked to the first item of each of
    their keys only, so a key shared by very many items costs one link per item, not per pair.
    """
    keys = items.select("ord", F.explode(_keys()).alias("k"))
    first = keys.groupBy("k").agg(F.min("ord").alias("a"))
    links = salted_lookup(keys, "k", first, "ord").where(F.col("a") < F.col("ord")).select("a", F.col("ord").alias("b"))
    groups = connected(links).select(F.col("node").alias("ord"), "root")
    return items.select("ord").join(groups, "ord", "left").select("ord", F.coalesce("root", "ord").alias("first_ord"))


def merge_heads(items: DataFrame) -> DataFrame:
    """Group head of every item over several days, without closure (E4): (ord, first_ord).

    In the order of ``ord``, an item joins the group of an earlier item with its fingerprint, else of
    the last earlier item with its URL, else it opens a group. Groups that only a later item connects stay apart.
    """
    digest, url = F.nullif("content_hash", F.lit("")), F.nullif("canonical_url", F.lit(""))
    keyed = items.select("ord", "date", digest.alias("digest"), F.when(digest.isNull() & url.isNull(), F.concat(F.lit("i:"), "id")).otherwise(F.concat(F.lit("u:"), url)).alias("link"))
    # Dealt out by ranges of ``ord``: parents are found inside a range first, then across them, and no window sees more of
    # a link than one range holds, or more than one row per range.
    ranged = materialize(keyed.drop("date").repartitionByRange("ord").withColumn("range", F.spark_partition_id()), "ranged")
    first = ranged.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("ord").alias("first"))
    linked = ranged.where(F.col("link").isNotNull())
    spans = linked.groupBy("link", "range").agg(F.max("ord").alias("last"))
    across = Window.partitionBy("link").orderBy("range")
    spans = spans.select("link", "range", F.lag("last").over(across).alias("earlier"))
    inside = Window.partitionBy("link", "range").orderBy("ord")
    previous = linked.withColumn("near", F.lag("ord").over(inside)).join(spans, ["link", "range"]).select("ord", F.coalesce("near", "earlier").alias("previous"))
    parents = salted_lookup(ranged.select("ord", "digest"), "digest", first, "ord", how="left").join(previous, "ord", "left")
    parents = parents.select("ord", F.when(F.col("first") < F.col("ord"), F.col("first")).otherwise(F.col("previous")).alias("up"))
    state = materialize(parents.select("ord", F.coalesce("up", "ord").alias("head"), F.col("up").isNotNull().alias("moved")), "heads")
    while not state.where("moved").isEmpty():
        above = state.select(F.col("ord").alias("head"), F.col("head").alias("above"))
        # Very many items can have one head: they reach it by (head, salt).
        climbed = salted_lookup(state.select("ord", "head"), "head", above, "ord").select("ord", F.col("above").alias("head"), (F.col("above") != F.col("head")).alias("moved"))
        state = materialize(climbed, "heads")
    return state.select("ord", F.col("head").alias("first_ord"))


def _story_keys() -> list[Column]:
    """The key that stands for an item, and the key of its URL."""
    digest, url = F.nullif("content_hash", F.lit("")), F.nullif("canonical_url", F.lit(""))
    link = F.concat(F.lit("u:"), url)
    key = F.coalesce(F.concat(F.lit("h:"), digest), link, F.concat(F.lit("i:"), F.col("id")), _order_key())
    return [key.alias("key"), link.alias("other")]


def _order_key() -> Column:
    return F.concat(F.lit("o:"), F.col("ord").cast("string"))


def _linked_keys(keyed: DataFrame) -> DataFrame:
    """Smallest key of the group of every key that is linked to others: (node, root). ``keyed``: (ord, key, other).

    Keys are linked where they share an ``other`` key, or an ``ord`` that came several times.
    """
    code = F.xxhash64("key")
    repeated = keyed.groupBy("ord").agg(F.min(code).alias("low"), F.max(code).alias("high")).where("low <> high").select("ord")
    repeated = materialize(repeated, "repeated")
    shared = keyed.where(F.col("other").isNotNull()).select("key", "other")
    shared = shared.unionByName(keyed.join(repeated, "ord", "left_semi").select("key", _order_key().alias("other")))
    pairs = materialize(shared.distinct(), "keys")
    least = pairs.groupBy("other").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("other", "a")
    links = salted_lookup(pairs, "other", least, "key").where(F.col("a") < F.col("key")).select("a", F.col("key").alias("b"))
    return connected(links)


def _closed_groups(items: DataFrame, rank: Column) -> DataFrame:
    """The groups of ``merge_groups`` with their best rank and all their dates: (first_ord, best, dates).

    Items are gathered by one key each before the keys are linked, so the rounds of linking see keys, and no item
    travels to its group.
    """
    placed = items.where(F.col("ord").isNotNull())
    kept = placed.groupBy(_story_keys()[0]).agg(F.min(rank).alias("best"), F.min("ord").alias("first_ord"), F.collect_set("date").alias("dates"))
    roots = _linked_keys(placed.select("ord", *_story_keys())).withColumnRenamed("node", "key")
    # Dates travel one by one: the lists of all keys of a group would have no bound.
    rooted = kept.join(roots, "key", "left").select(F.coalesce("root", "key").alias("root"), "best", "first_ord", F.explode_outer("dates").alias("date"))
    return rooted.groupBy("root").agg(F.min("best").alias("best"), F.min("first_ord").alias("first_ord"), F.collect_set("date").alias("dates"))


def merge_items(items: DataFrame, closure: bool = False) -> DataFrame:
    """One row per story over several days (E4): the best copy and all its report dates.

    ``ord`` rises from the newest day to the oldest. With ``closure``, chains of shared keys are one story.

    Best: lowest tier (missing counts as 9), then larger absolute impact, then the earlier ``ord``.
    ``first_ord`` gives the order of first appearance.
    """
    tier = F.coalesce(F.nullif("source_tier", F.lit(0)), F.lit(9))
    weaker = -F.abs(F.coalesce("impact_score", F.lit(0)))
    rank = F.struct(tier.alias("tier"), weaker.alias("weaker"), F.col("ord").alias("ord"))
    if closure:
        groups = _closed_groups(items, rank)
    else:
        dates = F.collect_set("date").alias("dates")  # bounded by the days in range
        groups = items.join(merge_heads(items), "ord").groupBy("first_ord").agg(F.min(rank).alias("best"), dates)
    stories = groups.select("first_ord", F.col("best.ord").alias("ord"), F.sort_array("dates", asc=False).alias("report_dates"))
    return items.join(materialize(stories, "stories") if closure else stories, "ord")
