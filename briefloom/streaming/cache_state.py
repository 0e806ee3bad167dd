"""Analysis cache in the state store of a stream (P3): the last row per key, gone once its time to live is over.

Each key holds one value, its last row, and one timer, set for its first row. It fires when the watermark passes that
row's time plus the time to live; if a later row is held by then, the timer is set anew for that one, else it takes the row
out of the state, whether or not the key ever comes again. So a row that replaces another one costs one read and one write
of the state. What changes is written as a log that
tells puts from expiries. The state of a key lives in one task; it is one row, whatever the number of rows of the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from briefloom.streaming.jobs import write_updates

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
#: The state store that keeps timers; part of Spark.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cache(StatefulProcessor):
    """Rows carry their time as microseconds since the epoch: it is compared and kept without a time zone."""

    def __init__(self, ts: str, tie: str, ttl_ms: int, schema: T.StructType):
        self.ts, self.tie, self.ttl_ms, self.schema = ts, tie, ttl_ms, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _held(self) -> Row | None:
        held = self.last.get()
        return None if held is None else Row(*self.schema.names)(*held)

    def _order(self, row: Row) -> tuple:
        return row[self.ts], row[self.tie]

    def _expiry(self, row: Row) -> int:
        return row[self.ts] // 1000 + self.ttl_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        old = self._held()
        new = max(rows, key=self._order)
        if old is not None and self._order(old) >= self._order(new):
            return
        if self._expiry(new) <= timerValues.getCurrentWatermarkInMs():
            return  # over before it came
        self.last.update(tuple(new[c] for c in self.schema.names))
        if old is None:
            self.handle.registerTimer(self._expiry(new))  # a held key has its timer, which fires no later than it should
        yield Row(*self.schema.names, "expired")(*[new[c] for c in self.schema.names], False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        old = self._held()
        if old is None:
            return
        if self._expiry(old) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._expiry(old))  # a later row came meanwhile
        else:
            self.last.clear()
            yield Row(*self.schema.names, "expired")(*[old[c] for c in self.schema.names], True)


def cache_changes(rows: DataFrame, key: str, ts: str, tie: str, ttl: timedelta, late: str = "0 seconds") -> DataFrame:
    """Change log of a cache over a stream: the columns of ``rows`` and ``expired``.

    Start it with ``write_changes``. A row of a key replaces the held one if (``ts``, ``tie``) is greater. ``late``: how far the watermark stays behind the
    newest row. Rows without key or time are left out; a row whose time to live is over when it arrives changes nothing.
    """
    timed = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__time", F.col(ts)).withWatermark("__time", late)
    numbered = timed.withColumn(ts, F.unix_micros(ts))
    state = T.StructType([f for f in numbered.schema.fields if f.name != "__time"])
    out = T.StructType([*state.fields, T.StructField("expired", T.BooleanType())])
    processor = _Cache(ts, tie, int(ttl / timedelta(milliseconds=1)), state)
    changes = numbered.groupBy(key).transformWithState(processor, out, "Update", "EventTime")
    return changes.withColumn(ts, F.timestamp_micros(ts))


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a change log into a table, batch by batch, with the state store it needs. Other streams keep theirs."""
    conf = changes.sparkSession.conf
    before = conf.get(STORE_CONF)
    conf.set(STORE_CONF, STORE)
    try:
        return write_updates(changes, path, checkpoint)
    finally:
        conf.set(STORE_CONF, before)


def live_rows(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """What the cache holds after the last batch of a change log that ``write_updates`` keeps."""
    names = schema.names
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField("expired", T.BooleanType()), T.StructField("batch_id", T.IntegerType())])).parquet(path)
    # Within a batch a put comes before its expiry: timers fire after the rows of the batch.
    last = log.groupBy(key).agg(F.max_by(F.struct(*names, "expired"), F.struct("batch_id", "expired")).alias("v"))
    return last.where("not v.expired").select("v.*").select(*names)
