"""Streams: exact dedup inside the lookback (P1), KPI per local day (P2), analysis cache with expiry.

Every job takes a streaming DataFrame and works the same on a batch one where that makes sense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from briefloom.operators.enrich import overlay_cache
from briefloom.operators.store import evict_expired, upsert_cache
from briefloom.session import delete_folder, materialize, new_path, partition_values


def dedup_stream(items: DataFrame, key: str = "canonical_url", lookback: str = "48 hours", ts: str = "published_at", ingested: str = "collected_at") -> DataFrame:
    """First row per key; state is dropped once the watermark passes the lookback.

    Undated rows take their ingest time, so they too expire.
    """
    timed = items.withColumn("event_time", F.coalesce(ts, ingested))
    return timed.withWatermark("event_time", lookback).dropDuplicatesWithinWatermark([key])


def day_window(ts: str = "event_time", offset_hours: int = 7) -> Column:
    """Calendar days of a fixed offset east of UTC, as windows over UTC instants."""
    return F.window(ts, "1 day", startTime=f"{(24 - offset_hours) % 24} hours")


def kpi_stream(items: DataFrame, aggregates: list[Column], ts: str = "event_time", late: str = "2 days", offset_hours: int = 7) -> DataFrame:
    """Counters per local day, updated as rows arrive; rows later than the watermark are left out."""
    return items.withWatermark(ts, late).groupBy(day_window(ts, offset_hours)).agg(*aggregates)


def write_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, fanout: int = 8) -> StreamingQuery:
    """Write the updated rows of every batch to a table, tagged with the batch, and stop at the end of input.

    A batch that is retried after a failure replaces its own partition. With ``keys`` the log is compacted by levels while
    the stream runs: ``fanout`` batches become one, ``fanout`` of those one again, and so on, so that readers open at most
    ``fanout`` folders of each level, and a row is rewritten once per level. A batch compacts only what was finished before
    it started; if it is retried, that is the same work once more.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def save(batch: DataFrame, batch_id: int) -> None:
        size = fanout
        while keys and batch_id and batch_id % size == 0:
            compact_updates(batch.sparkSession, path, schema, keys, batch_id - 1, batch_id - size)
            size *= fanout
        tagged = batch.withColumn("batch_id", F.lit(batch_id))
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Current value per key from the table ``write_updates`` keeps."""
    log = spark.read.schema(f"{schema}, batch_id int").parquet(path)
    values = [c for c in log.columns if c not in (*keys, "batch_id")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch_id")).alias("v"))
    return last.select(*keys, "v.*")


def compact_updates(spark: SparkSession, path: str, schema: str, keys: list[str], batch_id: int, first: int = 0) -> None:
    """Replace the batches from ``first`` to ``batch_id`` of the update log by one row per key, and delete the older of them.

    The compacted rows are written as the last of these batches first; rows of later batches still win over them.
    """
    stored = [int(b) for b in partition_values(spark, path, "batch_id")]
    merged = [b for b in stored if first <= b <= batch_id]
    if not merged or merged == [batch_id]:
        return
    log = spark.read.schema(f"{schema}, batch_id int").parquet(path).where(F.col("batch_id").between(first, batch_id))
    values = [c for c in log.columns if c not in (*keys, "batch_id")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch_id")).alias("v")).select(*keys, "v.*")
    compacted = materialize(last, "compacted").withColumn("batch_id", F.lit(batch_id))
    compacted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    for old in merged:
        if old < batch_id:
            delete_folder(spark, f"{path}/batch_id={old}")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all input that is there now into a table of the shared folder, and read it."""
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-state")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def with_cached_analysis(items: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Stream-static join: items whose fingerprint has a cached analysis that has not expired."""
    return overlay_cache(items, evict_expired(cache, now))


BUCKETS = 64


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("content_hash"), F.lit(BUCKETS)).cast("int"))


def cache_writer(path: str, now: Column):
    """``foreachBatch`` function that folds fresh analyses into a cache table keyed by fingerprint.

    The table is split into buckets by fingerprint. A batch reads and replaces only the buckets it touches, and the
    result does not depend on how often it is repeated, so a retried batch is harmless. Expired rows leave their
    bucket when it is next written, and are not returned by ``read_cache``.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = materialize(_bucketed(batch), "fresh")
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most one row per bucket
        if not touched:
            return
        old = fresh.limit(0)
        if partition_values(spark, path, "bucket"):
            old = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched))
        merged = materialize(upsert_cache(evict_expired(old, now), fresh), "cache")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return save


def read_cache(spark: SparkSession, path: str, schema: StructType, now: Column) -> DataFrame:
    """Rows of the cache table that have not expired."""
    return evict_expired(spark.read.schema(schema).parquet(path), now)
