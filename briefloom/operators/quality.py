"""Table validation and report readiness."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.schemas import (
    CHANNELS, CLASSIFICATIONS, DEADLINES, DEPARTMENTS, NEWS_CATEGORIES, PRIORITIES, TIME_HORIZONS,
)

Rule = tuple[str, Callable[[], Column]]

# Fixed value: text that looks like a leaked credential.
SECRET_PATTERN = "(?i)sk-ant-|api[_-]?key[\"':\\s]+[A-Za-z0-9_-]{20,}"


def in_domain(column: str, allowed: tuple[str, ...]) -> Rule:
    return f"{column}: not an allowed value", lambda: F.col(column).isNull() | ~F.col(column).isin(*allowed)


def in_range(column: str, low: float, high: float) -> Rule:
    return f"{column}: outside {low}..{high}", lambda: F.col(column).isNull() | ~F.col(column).between(low, high)


def not_empty(column: str) -> Rule:
    return f"{column}: empty", lambda: F.coalesce(F.length(column), F.lit(0)) < 1


def at_most(column: str, size: int) -> Rule:
    return f"{column}: more than {size} entries", lambda: F.coalesce(F.size(column), F.lit(0)) > size


def all_in(column: str, allowed: tuple[str, ...]) -> Rule:
    domain = lambda: F.array(*[F.lit(a) for a in allowed])
    return (
        f"{column}: entry not allowed",
        lambda: F.size(F.array_except(F.coalesce(F.col(column), F.array().cast("array<string>")), domain())) > 0,
    )


ANALYSIS_RULES: tuple[Rule, ...] = (
    not_empty("title_local"),
    not_empty("short_summary"),
    in_domain("classification", CLASSIFICATIONS),
    in_range("impact_score", -5, 5),
    in_range("confidence", 0, 100),
    in_range("relevance_score", 0, 100),
    in_domain("news_category", NEWS_CATEGORIES),
    all_in("affected_channels", CHANNELS),
    in_domain("okr_impact.O1", CLASSIFICATIONS),
    in_domain("okr_impact.O2", CLASSIFICATIONS),
    at_most("positive_impacts", 5),
    at_most("negative_impacts", 5),
    at_most("reasoning_summary", 3),
    at_most("recommended_actions", 4),
    (
        "recommended_actions: bad action",
        lambda: F.exists(
            F.coalesce(F.col("recommended_actions"), F.array()),
            lambda a: (F.coalesce(F.length(a["action"]), F.lit(0)) < 1)
            | ~F.coalesce(a["owner"].isin(*DEPARTMENTS), F.lit(False))
            | ~F.coalesce(a["priority"].isin(*PRIORITIES), F.lit(False))
            | ~F.coalesce(a["deadline"].isin(*DEADLINES), F.lit(False)),
        ),
    ),
    in_domain("time_horizon", TIME_HORIZONS),
)


def violations(df: DataFrame, rules: tuple[Rule, ...], out: str = "violations") -> DataFrame:
    """Names of the broken rules of every row, all rules in one projection (V1)."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(broken(), F.lit(name)) for name, broken in rules])))


def split_valid(df: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their violations."""
    checked = violations(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def array_defaults(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Absent lists become empty ones."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(types[c])) for c in columns})


def has_secret(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(SECRET_PATTERN), F.lit(False)) for c in columns])


def readiness(df: DataFrame, rules: tuple[Rule, ...], text_columns: tuple[str, ...]) -> DataFrame:
    """One row: rows, invalid rows, rows that seem to hold a secret, and whether the table is ready."""
    checked = violations(df, rules).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.size("violations") > 0).alias("invalid_rows"),
        F.count_if(has_secret(*text_columns)).alias("secret_rows"),
    )
    return checked.withColumn("ready", (F.col("invalid_rows") == 0) & (F.col("secret_rows") == 0))
