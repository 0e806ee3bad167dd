"""Robots rules as a table and the disallow filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefloom.functions.urls import origin_of, path_of
from briefloom.functions.text import trim_ws
from briefloom.operators.graph import salted_lookup

_PREFIX_CHARS = 8
_SALTS = 16


def robots_rules(files: DataFrame, user_agent: str) -> DataFrame:
    """Disallow rules that apply to an agent: (origin, rule). ``files``: origin, body.

    Every ``User-agent`` line switches the following rules on or off; ``Allow`` is ignored. Files are
    bounded documents, so the running flag is taken per file.
    """
    lines = files.select("origin", F.posexplode(F.split("body", "\r?\n")).alias("n", "raw"))
    clean = lines.withColumn("line", trim_ws(F.regexp_replace("raw", "#.*$", ""))).where(F.col("line") != "")
    parsed = clean.select(
        "origin",
        "n",
        F.lower(trim_ws(F.regexp_extract("line", "^([^:]*)", 1))).alias("k"),
        trim_ws(F.regexp_replace("line", "^[^:]*:?", "")).alias("v"),
    )
    mine = (F.col("v") == "*") | F.lit(user_agent.lower()).contains(F.lower("v"))
    w = Window.partitionBy("origin").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    flagged = parsed.withColumn("applies", F.last(F.when(F.col("k") == "user-agent", mine), ignorenulls=True).over(w))
    rule = flagged.where((F.col("k") == "disallow") & F.coalesce("applies", F.lit(False)) & (F.col("v") != ""))
    return rule.select("origin", F.col("v").alias("rule")).distinct()


def allowed_by_robots(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "ord") -> DataFrame:
    """Rows whose path no rule of their origin covers; origins without rules are allowed.

    Only pages of origins that have a rule are looked at. Their paths are cut to the lengths that the rules of the
    origin really have, and joined on origin and beginning, with the page's own number as salt: a site that holds a
    third of all pages is spread over tasks. Rules longer than the joined beginning are verified in full.
    """
    placed = pages.select(F.col(key), origin_of(F.col(url)).alias("origin"), path_of(F.col(url)).alias("path"))
    headed = rules.withColumn("head", F.substring("rule", 1, _PREFIX_CHARS))
    lengths = headed.groupBy("origin").agg(F.collect_set(F.length("head")).alias("lengths"))  # at most eight
    ruled = salted_lookup(placed, "origin", lengths, key)
    heads = F.transform("lengths", lambda n: F.substring("path", F.lit(1), n))
    probes = ruled.select(key, "path", F.explode(F.array_distinct(heads)).alias("head"), "origin", F.pmod(F.xxhash64(key), F.lit(_SALTS)).alias("salt"))
    salted = headed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint"))))
    blocked = probes.join(salted, ["origin", "head", "salt"]).where((F.col("rule") == "/") | F.col("path").startswith(F.col("rule")))
    return pages.join(blocked.select(key).distinct(), key, "left_anti").where(origin_of(F.col(url)).isNotNull())
