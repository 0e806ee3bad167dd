"""Raw item scans and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from briefloom.operators.normalize import with_defaults
from briefloom.schemas import RAW_ITEM
from briefloom.session import dense_order


def read_raw_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw items with an explicit schema and defaults for what collectors may leave out."""
    return with_defaults(spark.read.schema(RAW_ITEM).format(fmt).load(path))


def _whole_items(merged: DataFrame, *extra: str) -> DataFrame:
    wanted = StructType.fromDDL(RAW_ITEM)
    have = set(merged.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields]
    return with_defaults(merged.select(*cols, *extra))


def ordered_union(parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """All sources in one table with their place in the item order, ``ord``.

    Every part is (rows, order columns of type integer, most significant first, unique in the part).
    Parts keep their order. The numbers are dense, whatever the size of the order columns.
    """
    places = [
        df.withColumn("__place", F.array(F.lit(i).cast("bigint"), *[F.col(c).cast("bigint") for c in order])).drop("ord")
        for i, (df, order) in enumerate(parts)
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), places)
    return dense_order(_whole_items(merged, "__place"), "__place").drop("__place")


def enabled_sources(sources: DataFrame) -> DataFrame:
    """Sources that are switched on."""
    return sources.where(F.coalesce("enabled", F.lit(True)))
