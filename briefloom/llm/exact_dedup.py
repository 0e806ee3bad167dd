"""Exact deduplication by a tree merge of digest runs. DataFrame functions only.

Every row becomes a digest of its whole text (SHA-256, with length and a second hash as verification). The rows are
dealt into shards by their id. A shard's run holds one entry per digest: the identifier to retain and the number of
rows. Runs are cut into stretches of the digest range, so that no task ever holds a whole one. In every round the runs of
``2**bits`` neighbouring shards are exchanged, stretch by stretch, and merged in the order of digest, length, second hash
and identifier: of entries that agree in the first three, the first one stays and takes the count of all. After the last
round one sorted run is left, with one entry per text. It travels back by digest to at most one entry per shard, and from
there to the rows of that shard, so that a text that a third of all rows carry never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import ids_and_texts, text_or_empty
from briefloom.session import materialize

_KEY = ("digest", "n_bytes", "check")


def _run(rows: DataFrame, retain: str) -> DataFrame:
    """The run of every shard: an entry per verified digest. Rows are combined before they travel."""
    best = F.max("__id") if retain == "largest" else F.min("__id")
    return rows.groupBy("shard", "stretch", *_KEY).agg(best.alias("best"), F.sum("n").alias("n"))


def _exchanged(runs: DataFrame, retain: str, bits: int) -> DataFrame:
    """One round: runs of neighbouring shards meet by stretch and become one sorted run with one entry per digest.

    An entry meets at most one of its kind from each of the merged runs.
    """
    met = runs.withColumn("shard", F.shiftright("shard", bits)).repartition("shard", "stretch")
    order = F.desc_nulls_last("best") if retain == "largest" else F.asc_nulls_last("best")
    same = Window.partitionBy("shard", "stretch", *_KEY).orderBy(order)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = met.withColumns({"place": F.row_number().over(same), "n": F.sum("n").over(whole)})
    return placed.where("place = 1").drop("place")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", retain: str = "largest", shards: int = 64, bits: int = 2,
    stretches: int = 1024,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``retain``: whether the "largest" or the "smallest" identifier of equal texts stays. Null texts are equal to empty
    ones. ``stretches``: parts of the digest range, each a task's share of a run. Null identifiers rank behind all others; in a group of null identifiers ``keep_id`` is null. Of rows repeated
    with equal identifier and text, exactly one is kept. An empty table gives an empty result. Other columns are not read.
    """
    if retain not in ("largest", "smallest"):
        raise ValueError("retain must be 'largest' or 'smallest'")
    text = text_or_empty(F.col("__text"))
    rows = ids_and_texts(docs, id_col, text_col).select(
        F.col("__id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
        F.pmod(F.xxhash64("__id"), F.lit(shards)).cast("int").alias("shard"),
    )
    # Rows with equal identifier and text are one row with a count from here on.
    rows = materialize(rows.groupBy("shard", *_KEY, "__id").agg(F.count(F.lit(1)).alias("n")), "digests")
    # The first 32 bits of a digest, scaled: stretches follow the order of digests.
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    stretch = F.shiftright(lead * stretches, 32).cast("int")
    first = _run(rows.withColumn("stretch", stretch), retain)
    runs, width = first, shards
    while width > 1:
        width = -(-width // 2**bits)
        runs = _exchanged(runs, retain, bits)
    final = runs.select(*_KEY, F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    by_shard = first.select("shard", *_KEY).join(final, list(_KEY))
    one = rows.join(by_shard, ["shard", *_KEY]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return one.select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", retain: str = "largest") -> DataFrame:
    """The rows that stay, with all their columns. Of rows repeated with equal identifier and text any one stays.

    Null texts equal empty ones. A null identifier stays only where no row of the group has one. An empty table gives an
    empty one.
    """
    groups = exact_groups(docs, id_col, text_col, retain)
    kept = groups.where("kept").select(F.col(id_col).alias("__keep"), F.col("text_sha256").alias("__digest"))
    digest = F.sha2(text_or_empty(docs[f"`{text_col}`"].cast("string")), 256)
    stay = docs.join(kept, docs[f"`{id_col}`"].eqNullSafe(kept["__keep"]) & (digest == kept["__digest"]), "left_semi")
    repeated = groups.where("not kept").select(F.col(id_col), "keep_id").where(F.col(id_col).eqNullSafe(F.col("keep_id")))
    if repeated.isEmpty():
        return stay
    empty = text_or_empty(F.col(f"`{text_col}`").cast("string"))
    return stay.withColumn("__same text", F.sha2(empty, 256)).dropDuplicates([id_col, "__same text"]).drop("__same text")
