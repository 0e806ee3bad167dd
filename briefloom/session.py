"""Session helpers: where intermediate tables go and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is used only on a local master, where no such setting is needed.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="briefloom-")
    return _LOCAL_DIR


_LOCAL_DIR: str | None = None


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/briefloom/{spark.sparkContext.applicationId}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark can write to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a table's partition folders, without opening a data file; none if there is no table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [e.getPath().getName() for e in store.listStatus(folder)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def drop_intermediate(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    delete_folder(spark, _run_dir(spark))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a costly step over a table of few files. For bare scans only.

    A scan knows its partitions from the file listing, nothing runs for it. Only a table that comes
    in fewer partitions than there are cores is redistributed; such a table is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are costly and used several times, also by later filters.

    A plain projection would be undone: the optimizer pushes filters below it and repeats the
    expressions there. Unfolding a one-row list keeps the computation in one place.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    rest = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(row)))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("v")).scalar()
    added = df.withColumn("__one", packed)
    return added.select(*df.columns, *[F.col("__one")[c].alias(c) for c in one_row.columns])


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    This cuts the lineage of iterative plans, survives lost executors, and gives the optimizer
    true sizes for its join choices.
    """
    path = new_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_order(df: DataFrame, *order: Column | str, name: str = "ord") -> DataFrame:
    """Number all rows 0, 1, 2 ... in a total order, without a global window.

    Rows are dealt out by ranges of the order and written; each range is numbered by itself, and the
    sizes of the ranges before it, one row per range, are added. ``order`` must be unique.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ordered")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order)
    numbered = ranged.join(offsets, "__range").withColumn(name, F.col("__before") + F.row_number().over(inside) - 1)
    return numbered.drop("__range", "__before")


def parallelism(df: DataFrame) -> int:
    """Tasks of a step whose cost is not visible in its bytes; adaptive coalescing must not shrink it."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
