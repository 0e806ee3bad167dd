"""One switch for many tables (B1, O1): rows are staged in folders of their own, and a manifest names those that are live.

``root/<table>[/date=<day>]/run=<run>`` holds what one run wrote of a table; ``root/manifest`` has one row per table and
day. A run stages all its folders first and then writes the next version of the manifest: this one commit shows all of
them at once. A run that ends before it leaves folders that no reader looks at, and that the next run deletes. Readers
resolve tables through the last finished manifest; what the one before it names is kept as well, for readers that have
started. There is one writer at a time: of two that commit together, the second fails.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from briefloom.operators.quality import Rule
from briefloom.operators.store import finished_versions, read_version, require_valid, write_version
from briefloom.session import delete_folder, partition_values

_SCHEMA = "name string, date date, run string"


class DayStore:
    """Tables under one root, by day or as a whole, as the last finished run left them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def live(self) -> list[Row]:
        """(name, date, run) of every live folder: one row per table and kept day."""
        return read_version(self.spark, f"{self.root}/manifest", _SCHEMA).collect()

    def days(self, name: str) -> list[date]:
        return sorted(r["date"] for r in self.live() if r["name"] == name)

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """A table, with its ``date`` if it is kept by day. Without a live folder an empty one, or None if no schema is given."""
        paths = [_folder(self.root, *r) for r in self.live() if r["name"] == name]
        if not paths:
            return None if schema is None else self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        df = (reader if schema is None else reader.schema(schema)).parquet(*paths).drop("run")
        return df.withColumn("date", F.col("date").cast("date")) if "date" in df.columns else df

    def begin(self) -> Change:
        return Change(self)


class Change:
    """What one run stages and then shows at once."""

    def __init__(self, store: DayStore):
        self.store, self.run = store, f"r{uuid.uuid4().hex}"
        self.entries = {(r["name"], r["date"]): r["run"] for r in store.live()}

    def put(self, name: str, df: DataFrame, day: date | None = None, rules: tuple[Rule, ...] = ()) -> None:
        """Stage a table, or its rows of one day. Rows that break a rule stop the run; nothing of it is ever shown."""
        require_valid(df, rules).drop(*(["date"] if day else [])).write.parquet(_folder(self.store.root, name, day, self.run))
        self.entries[name, day] = self.run

    def keep_days(self, days: set[date]) -> list[date]:
        """Take all other days of all tables out of view, and return them."""
        gone = {key for key in self.entries if key[1] is not None and key[1] not in days}
        for key in gone:
            del self.entries[key]
        return sorted({day for _, day in gone})

    def commit(self) -> None:
        """Show everything that was staged, then delete what neither this manifest nor the one before it names."""
        spark, root = self.store.spark, self.store.root
        rows = [(name, day, run) for (name, day), run in self.entries.items()]
        write_version(spark.createDataFrame(rows, _SCHEMA).coalesce(1), f"{root}/manifest")
        named = set()
        for version in finished_versions(spark, f"{root}/manifest"):
            named |= {tuple(r) for r in spark.read.schema(_SCHEMA).parquet(f"{root}/manifest/version={version}").collect()}
        for name in {n for n, _, _ in named}:
            days = [date.fromisoformat(d) for d in partition_values(spark, f"{root}/{name}", "date")] or [None]
            for day in days:
                for run in partition_values(spark, _parent(root, name, day), "run"):
                    if (name, day, run) not in named:
                        delete_folder(spark, _folder(root, name, day, run))


def _parent(root: str, name: str, day: date | None) -> str:
    return f"{root}/{name}" if day is None else f"{root}/{name}/date={day.isoformat()}"


def _folder(root: str, name: str, day: date | None, run: str) -> str:
    return f"{_parent(root, name, day)}/run={run}"
