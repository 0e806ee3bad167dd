"""Report tables: partitioned writes, history index, retention, analysis cache."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.operators.quality import Rule, split_valid
from briefloom.session import delete_folder, partition_values

RETENTION_DAYS = 31
CACHE_DAYS = 14


def require_valid(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same rows; an error if any of them breaks a rule."""
    if not rules:
        return df
    good, bad = split_valid(df, rules)
    broken = bad.select(F.array_join("violations", "; ").alias("v")).limit(1).collect()
    if broken:
        raise ValueError(f"report rows break the schema: {broken[0]['v']}")
    return good


def write_day(df: DataFrame, path: str, rules: tuple[Rule, ...] = ()) -> None:
    """Replace the partitions of the dates in ``df`` and leave all others alone (B1).

    Rows that break a rule stop the write before any partition is touched.
    """
    require_valid(df, rules).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def upsert_index(index: DataFrame, entries: DataFrame, keep: int = RETENTION_DAYS) -> DataFrame:
    """Index with the entries replaced by date, newest first, at most ``keep`` days."""
    kept = index.join(F.broadcast(entries.select("date")), "date", "left_anti")
    return kept.unionByName(entries.select(*index.columns)).orderBy(F.desc("date")).limit(keep)


def stored_dates(spark: SparkSession, path: str) -> list[date]:
    """Dates of a report table, from its partition folders; no data file is opened."""
    return [date.fromisoformat(d) for d in partition_values(spark, path, "date") if re.fullmatch(r"\d{4}-\d{2}-\d{2}", d)]


def expired_partitions(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Stored dates that the index no longer lists (B3, D11): one row per day."""
    days = spark.createDataFrame([(d,) for d in stored_dates(spark, path)], "date date")
    return days.join(index.select("date"), "date", "left_anti")


def prune(spark: SparkSession, path: str, index: DataFrame) -> list[date]:
    """Delete the partitions of expired dates and return them."""
    expired = [r["date"] for r in expired_partitions(spark, path, index).collect()]  # one row per day
    for day in expired:
        delete_folder(spark, f"{path}/date={day.isoformat()}")
    return expired


def evict_expired(cache: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Cache rows younger than the time to live."""
    return cache.where(F.col("saved_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per fingerprint, the last saved one (B5). Ties go to the fresh rows."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(fresh.select(*cache.columns).withColumn("__new", F.lit(1)))
    # Only fingerprints and times are aggregated; rows are picked by both, and repeated ones collapse.
    rank = 2 * F.unix_micros("saved_at") + F.col("__new")
    last = both.groupBy(F.col("content_hash").alias("__hash")).agg(F.max(rank).alias("__last"))
    picked = both.join(last, (F.col("content_hash") == F.col("__hash")) & (rank == F.col("__last")), "left_semi")
    return picked.drop("__new").dropDuplicates(["content_hash"])


def new_rows(report: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not stored yet."""
    return report.join(stored.select(key).distinct(), key, "left_anti")


def has_new_rows(report: DataFrame, stored: DataFrame | None) -> bool:
    return stored is None or not new_rows(report, stored).limit(1).isEmpty()


# ---- scans ----


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("date", F.col("date").cast("date"))


def read_report(spark: SparkSession, path: str, day: str) -> DataFrame | None:
    """One day of a report table (A13): partition-pruned; null for a malformed or missing date."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) or day not in partition_values(spark, path, "date"):
        return None
    df = read_reports(spark, path).where(F.col("date") == F.lit(day).cast("date"))
    return None if df.limit(1).isEmpty() else df


def latest_of(reports: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the newest day of an index (A14). The day is a subquery of the scan: when it is known, at run time, the scan
    lists and opens that partition only, and nothing of it comes to the driver's program."""
    return reports.where(F.col("date") == index.agg(F.max("date")).scalar())


def read_latest(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Newest report of a table by day."""
    return latest_of(spark.read.parquet(path), index)


def read_dates(spark: SparkSession, path: str, days: list[date]) -> DataFrame:
    """Several days, newest first; days without a report return nothing."""
    return spark.read.parquet(path).where(F.col("date").isin(days)).orderBy(F.desc("date"))


# ---- small tables that are replaced as a whole ----


def write_version(df: DataFrame, path: str) -> None:
    """Write the next version of a table and delete the ones before the last: readers always find a whole one."""
    spark = df.sparkSession
    versions, finished = [int(v) for v in partition_values(spark, path, "version")], finished_versions(spark, path)
    df.write.parquet(f"{path}/version={max(versions, default=0) + 1}")
    for old in set(versions) - set(finished[-1:]):
        delete_folder(spark, f"{path}/version={old}")


def read_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Last finished version of a table; empty if there is none."""
    finished = finished_versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={finished[-1]}") if finished else spark.createDataFrame([], schema)


def finished_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that were written to their end, in order."""

    def finished(version: int) -> bool:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/_SUCCESS")
        return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)

    return [v for v in sorted(map(int, partition_values(spark, path, "version"))) if finished(v)]
