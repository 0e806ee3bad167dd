"""Connected groups of a link table, and lookups on keys that very many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.session import materialize


def salted_lookup(rows: DataFrame, key: str, values: DataFrame, salt_by: str, salts: int = 64, how: str = "inner") -> DataFrame:
    """Add the columns of ``values`` (one row per ``key``) to ``rows``; with "inner", rows without a value are dropped.

    A key that a third of all rows hold does not meet in one task: the values go to every (key, salt) that occurs, at
    most ``salts`` rows of a key, and from there to the rows.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    spread = salted.groupBy(key, "__salt").agg(F.lit(1).alias("__one")).drop("__one").join(values, key)
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


def connected(links: DataFrame) -> DataFrame:
    """Smallest member of the group of every linked node: (node, root). ``links``: (a, b) of one orderable type.

    Every node keeps its smallest neighbour and hands the other smaller ones to that neighbour, until each has one
    parent; then parents are replaced by their parents until nothing changes. Null ends and self links do not count.
    """
    edges = materialize(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "parents")
        several = least.where("n > 1").select("u", "m")
        if several.isEmpty():
            break
        handed = edges.join(several, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(least.select("u", F.col("m").alias("v")).unionByName(handed).distinct(), "links")
    state = least.select(F.col("u").alias("node"), F.col("m").alias("root"), F.lit(True).alias("moved"))
    while True:
        up = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        climbed = salted_lookup(state.select("node", "root"), "root", up, "node", how="left")  # very many nodes can have one root
        state = materialize(
            climbed.select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots"
        )
        if state.where("moved").isEmpty():
            break
    roots = state.select("root").distinct()
    return state.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root"))
