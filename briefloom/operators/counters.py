"""Stage counters that ride on passes which run anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageCounts:
    """Counts of rows, observed while the tables they belong to are written.

    Observe in the last stage of a write, with nothing but projections and filters up to the writer: tasks of that stage
    count once, however often executors are lost. Rows in front of a shuffle may be counted again when it is repeated.
    Read the counts after the write; a stage the optimizer found empty counts 0.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[Observation, tuple[str, ...]]] = []

    def at(self, df: DataFrame, **stages: Column | None) -> DataFrame:
        """The same table, watched. ``stages``: condition of the rows that count for each name, or None for all rows."""
        seen = Observation()
        self._watched.append((seen, tuple(stages)))
        counts = [(F.count(F.lit(1)) if when is None else F.count_if(when)).alias(name) for name, when in stages.items()]
        return df.observe(seen, *counts)

    def values(self) -> dict[str, int]:
        return {name: seen.get.get(name) or 0 for seen, names in self._watched for name in names}

    def row(self, spark: SparkSession, *order: str) -> DataFrame:
        """One row with a column per stage."""
        counts = self.values()
        return spark.range(1).select(*[F.lit(counts[name]).cast("bigint").alias(name) for name in order or counts])
