"""Chat logs: collapse cumulative snapshots, then render what is left.

Logs often hold a conversation several times, each copy with more turns. Every turn gets a hash of its position, role
and text; the running combination over a conversation's turns is a hash of the prefix that ends there. A conversation
whose full hash is the prefix hash of a longer one is a snapshot: an anti-join on these hashes removes it. Of equal
conversations the smallest identifier stays. Only the maximal ones are gathered and rendered.

Running values are formed in two steps, inside stretches of turns and over the stretches, so that no conversation has
to pass through one window as a whole. Both sides of the anti-join hold each hash once: a first turn that very many
conversations share is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from briefloom.session import materialize

STRETCH = 256  # turn numbers per stretch


def positioned(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, role, text, h1, h2``: position of each turn, and the hash of the prefix that ends with it.

    Rows that repeat a turn exactly count once. Null roles and texts count as empty. Turns are ordered by number, null
    first, then by role and text. Null conversation identifiers are one conversation.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62))))
    inside = W.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("rank", F.row_number().over(inside))
    sizes = rows.groupBy("conv", "stretch").agg(F.max("rank").alias("size"))
    before = W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = _with(rows, sizes, ("offset",)).withColumn("pos", F.col("offset") + F.col("rank"))
    placed = placed.withColumns({"t1": F.xxhash64("pos", "role", "text"), "t2": F.xxhash64(F.lit("second"), "text", "role", "pos")})
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.withColumns({"i1": F.bit_xor("t1").over(running), "i2": F.bit_xor("t2").over(running)})
    totals = placed.groupBy("conv", "stretch").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    totals = totals.select("conv", "stretch", *[F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    return _with(placed, totals, ("b1", "b2")).select(
        "conv", "pos", "role", "text", F.col("i1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("i2").bitwiseXOR(F.col("b2")).alias("h2")
    )


def _with(rows: DataFrame, by_stretch: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add columns of a stretch to its rows, null identifiers included."""
    side = by_stretch.select(F.col("conv").alias("__conv"), F.col("stretch").alias("__stretch"), *columns)
    return rows.join(side, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("stretch") == F.col("__stretch"))).drop("__conv", "__stretch")


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv, n_turns, n_copies`` of the conversations that no longer one continues; of equal ones the smallest id.

    ``n_copies``: conversations equal to it, itself included.
    """
    ends = prefixes.groupBy("conv").agg(F.max(F.struct("pos", "h1", "h2")).alias("end"))
    full = ends.groupBy("end.pos", "end.h1", "end.h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    side = ends.select(F.col("conv").alias("__conv"), F.col("end.pos").alias("last"))
    inner = prefixes.select("conv", "pos", "h1", "h2").join(side, F.col("conv").eqNullSafe(F.col("__conv"))).where("pos < last")
    inner = inner.select("pos", "h1", "h2").distinct()
    return full.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv", F.col("pos").alias("n_turns"), "n_copies")


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    before_role: str = "<|", after_role: str = "|>\n", after_turn: str = "<|end|>\n",
) -> DataFrame:
    """``conv_col, n_turns, n_copies, rendered``: the maximal conversations as texts.

    See ``positioned`` for ties, nulls and repeated rows, ``maximal`` for what stays. A null and a named conversation
    with equal turns are equal: the named one stays. An empty table gives an empty result; other columns are not read.
    """
    prefixes = materialize(positioned(turns, conv_col, turn_col, role_col, text_col), "turns")
    kept = materialize(maximal(prefixes), "maximal").select(F.col("conv").alias("__conv"), "n_turns", "n_copies")
    one = F.concat(F.lit(before_role), F.col("role"), F.lit(after_role), F.col("text"), F.lit(after_turn))
    rows = prefixes.join(kept, F.col("conv").eqNullSafe(F.col("__conv"))).select("conv", "n_turns", "n_copies", F.struct("pos", one.alias("part")).alias("turn"))
    return rows.groupBy("conv").agg(
        F.first("n_turns").alias("n_turns"),
        F.first("n_copies").alias("n_copies"),
        F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t["part"]), "").alias("rendered"),
    ).withColumnRenamed("conv", conv_col)
