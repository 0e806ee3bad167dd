"""Cached, budgeted enrichment with a pluggable batch model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from briefloom.functions.text import truncate
from briefloom.lexicons.model import RuleSet
from briefloom.operators.classify import ANALYSIS_COLUMNS, classify
from briefloom.operators.quality import ANALYSIS_RULES, violations
from briefloom.session import materialize, parallelism

#: Batches of (ord, content_hash, prompt) in, batches with ord and the analysis columns out.
BatchModel = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

PROVENANCE = ("analyzed_by", "analysis_model")

# Input and output price in USD per million tokens of a model that is not in the
# price table, and the factors on the input price for cache writes and reads.
DEFAULT_PRICE = (5.0, 25.0)
CACHE_WRITE_FACTOR = 1.25
CACHE_READ_FACTOR = 0.1


@dataclass(frozen=True)
class PromptLabels:
    """Wording of the model input; every label starts a line."""

    title: str = "Headline"
    outlet: str = "Outlet"
    tier: str = "tier"
    unverified: str = "not verified"
    country: str = "Country"
    language: str = "Language"
    published: str = "Published"
    undated: str = "unknown"
    press_release: str = "Form: press release"
    sponsored: str = "Form: paid content"
    text: str = "Text"
    competitors: str = "Competitors named"
    brands: str = "Brands named"
    coverage: str = "Other outlets with this story"


@dataclass(frozen=True)
class EnrichOptions:
    #: best-scored items a model may see; all by default, the budget is the stop
    max_model_items: int | None = None
    max_input_chars: int | None = None
    model_name: str | None = None
    labels: PromptLabels = PromptLabels()


@dataclass(frozen=True)
class Enrichment:
    """Tables of one enrichment."""

    items: DataFrame  #: every item with its analysis
    errors: DataFrame  #: (ord, scope, message): batches the model failed on, answers that break the schema
    fresh: DataFrame  #: cache rows of new model answers: content_hash, analysis, provenance


def prompt_text(options: EnrichOptions = EnrichOptions()) -> Column:
    """Model input of an item: one line per fact that is present (F12). Needs ``coverage_count``."""
    words = options.labels

    def line(label: str, *value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), *value)

    note = F.when(F.col("unverified"), F.lit(f", {words.unverified}")).otherwise(F.lit(""))
    when = F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(words.undated))
    return F.concat_ws(
        "\n",
        line(words.title, F.col("title")),
        line(words.outlet, F.col("source_name"), F.lit(f" ({words.tier} "), F.col("source_tier").cast("string"), note, F.lit(")")),
        line(words.country, F.col("source_country")),
        line(words.language, F.col("language")),
        line(words.published, when),
        F.when(F.col("is_press_release"), F.lit(words.press_release)),
        F.when(F.col("is_sponsored"), F.lit(words.sponsored)),
        F.when(F.size("matched_competitors") > 0, line(words.competitors, F.array_join("matched_competitors", ", "))),
        F.when(F.size("matched_brands") > 0, line(words.brands, F.array_join("matched_brands", ", "))),
        F.when(F.col("coverage_count") > 0, line(words.coverage, F.col("coverage_count").cast("string"))),
        line(words.text, truncate(F.col("snippet"), options.max_input_chars)),
    )


def overlay_cache(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Stored analyses laid over the current item fields, for items whose fingerprint is cached.

    ``cache`` has content_hash (unique), the analysis columns, analyzed_by and analysis_model.
    """
    stored = cache.select("content_hash", *ANALYSIS_COLUMNS, *PROVENANCE)
    return items.drop(*ANALYSIS_COLUMNS, *PROVENANCE).join(stored, "content_hash")


def enrich(
    items: DataFrame,
    rules: RuleSet,
    cache: DataFrame | None = None,
    model: BatchModel | None = None,
    options: EnrichOptions = EnrichOptions(),
    budget: Callable[[DataFrame], DataFrame] | None = None,
) -> Enrichment:
    """Analysis of every item (J1): cached, else by the model for the highest scores, else by the rules.

    A limit on model items counts cache hits, so the top rows are picked before hits are removed. They are
    picked with a sorted limit; no global window runs over the table. Where the model fails or its answer
    breaks the schema, the rules decide and an error row is kept. ``budget`` takes the candidates (ord,
    prefilter_score, content_hash, prompt) and returns those that may be asked (see ``within_budget``).
    """
    # Met with the cache once, and written: hits, misses and the rows for the model are filters of one table.
    marked = items.withColumn("__stored", F.lit(None).cast("boolean"))
    if cache is not None:
        stored = cache.select("content_hash", F.struct(*ANALYSIS_COLUMNS, *PROVENANCE).alias("__stored"))
        marked = materialize(items.join(stored, "content_hash", "left").select(*[items[c] for c in items.columns], "__stored"), "cached")
    misses = marked.where("__stored is null").drop("__stored")
    parts = []
    rest = misses
    schema = classify(misses, rules).select("ord", *ANALYSIS_COLUMNS).schema
    spark = items.sparkSession
    errors = spark.createDataFrame([], "ord bigint, scope string, message string")
    answers = spark.createDataFrame([], schema)
    if model is not None:
        answers, errors = _model_answers(marked, misses, schema, model, options, budget)
        rest = misses.join(answers.select("ord"), "ord", "left_anti")
        bare = misses.drop(*ANALYSIS_COLUMNS, *PROVENANCE)
        parts.append(_from(bare.join(answers, "ord"), "ai", options.model_name))
    # Only rows without a cached or a model result are classified by the rules.
    parts.insert(0, _from(classify(rest, rules), "fallback", None))
    if cache is not None:
        hits = marked.where("__stored is not null").drop(*ANALYSIS_COLUMNS, *PROVENANCE)
        parts.append(hits.select("*", "__stored.*").drop("__stored"))
    final = reduce(lambda x, y: x.unionByName(y.select(*x.columns)), parts)
    final = final.withColumns({"source_url": F.col("canonical_url"), "title_original": F.col("title"), "original_snippet": F.col("snippet")})
    fresh = _from(misses.select("ord", "content_hash").join(answers, "ord"), "ai", options.model_name)
    return Enrichment(final, errors, fresh.select("content_hash", *ANALYSIS_COLUMNS, *PROVENANCE))


def _from(df: DataFrame, by: str, model: str | None) -> DataFrame:
    return df.withColumns({"analyzed_by": F.lit(by), "analysis_model": F.lit(model).cast("string")})


def _guarded(model: BatchModel, columns: list[str]) -> BatchModel:
    """The model, called batch by batch; a batch it fails on gives rows with the error instead of ending the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = [answer.assign(error=None) for answer in model(iter([batch]))]
            except Exception as e:  # noqa: BLE001  whatever a model raises
                failed = {c: [None] * len(batch) for c in columns} | {"ord": batch["ord"], "error": f"{type(e).__name__}: {e}"}
                found = [pd.DataFrame(failed, index=batch.index)]
            yield from (x[[*columns, "error"]] for x in found)

    return run


def _model_answers(
    marked: DataFrame,
    misses: DataFrame,
    schema: StructType,
    model: BatchModel,
    options: EnrichOptions,
    budget: Callable[[DataFrame], DataFrame] | None,
) -> tuple[DataFrame, DataFrame]:
    """Valid model answers for the best-scored items (ord and the analysis columns), and error rows."""
    asked = misses
    if options.max_model_items is not None:
        asked = marked.orderBy(F.desc("prefilter_score"), "ord").limit(options.max_model_items).where("__stored is null")
    asked = asked.select("ord", "prefilter_score", "content_hash", prompt_text(options).alias("prompt"))
    if budget is not None:
        asked = budget(asked)
    # A model call costs far more than its bytes show: the rows are dealt out to all tasks, also after a limit.
    dealt = asked.select("ord", "content_hash", "prompt").repartition(parallelism(asked), "ord")
    nullable = StructType([StructField(f.name, f.dataType, True) for f in schema.fields] + [StructField("error", StringType())])
    # Written once: a model must not be called again when the rows are read twice.
    answers = materialize(dealt.mapInPandas(_guarded(model, schema.names), nullable), "model-answers")
    good, failed = answers.where("error is null").drop("error"), answers.where("error is not null")
    checked = violations(good, ANALYSIS_RULES)
    valid = checked.where(F.size("violations") == 0).drop("violations")
    broken = checked.where(F.size("violations") > 0).select("ord", F.lit("model answer").alias("scope"), F.array_join("violations", "; ").alias("message"))
    errors = failed.select("ord", F.lit("model call").alias("scope"), F.col("error").alias("message")).unionByName(broken)
    return valid, errors


def origin_counts(analyzed: DataFrame) -> DataFrame:
    return analyzed.agg(
        F.count_if(F.col("analyzed_by") == "ai").alias("ai_count"),
        F.count_if(F.col("analyzed_by") == "fallback").alias("fallback_count"),
    )


def price_per_model(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Input and output price of each model name (D14): exact id, else first id it starts with, else default.

    Works on the distinct model names, of which there are few, so the prefix join stays small.
    """
    names = usage.select("model").distinct()
    candidate = names.join(prices, F.col("model").startswith(F.col("model_id")), "left")
    best = candidate.groupBy("model").agg(
        F.min_by(
            F.struct("input_price", "output_price"),
            F.struct((F.col("model_id") != F.col("model")).alias("inexact"), F.col("ord")),
        ).alias("p")
    )
    return best.select(
        "model",
        F.coalesce("p.input_price", F.lit(DEFAULT_PRICE[0])).alias("input_price"),
        F.coalesce("p.output_price", F.lit(DEFAULT_PRICE[1])).alias("output_price"),
    )


def prices_df(spark: SparkSession, prices: list[tuple[str, float, float]]) -> DataFrame:
    """Price table from (model id, input price, output price) rows, in lookup order."""
    rows = [(m, i, o, n) for n, (m, i, o) in enumerate(prices)]
    return spark.createDataFrame(rows, "model_id string, input_price double, output_price double, ord int")


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost in USD of each call (J2) from its four token counts."""
    priced = usage.join(price_per_model(usage, prices), "model")
    zero = F.lit(0)
    cost = (
        F.coalesce("input_tokens", zero) / 1e6 * F.col("input_price")
        + F.coalesce("cache_write_tokens", zero) / 1e6 * F.col("input_price") * CACHE_WRITE_FACTOR
        + F.coalesce("cache_read_tokens", zero) / 1e6 * F.col("input_price") * CACHE_READ_FACTOR
        + F.coalesce("output_tokens", zero) / 1e6 * F.col("output_price")
    )
    return priced.withColumn("cost_usd", cost).drop("input_price", "output_price")


def within_budget(calls: DataFrame, budget_usd: float, group: list[str], order: list[Column], cost: str = "cost_usd") -> DataFrame:
    """Mark calls whose group had budget left before them (J3): running cost of the earlier calls < budget.

    The running sum is taken in two steps: sums per (group, slot) first, then within each slot, so
    one large group is spread over many tasks. ``slot`` must be a column that orders like ``order``.
    """
    spent_slot = calls.groupBy(*group, "slot").agg(F.sum(cost).alias("slot_cost"))
    before_slot = spent_slot.withColumn(
        "spent_before_slot",
        F.coalesce(
            F.sum("slot_cost").over(Window.partitionBy(*group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0.0),
        ),
    ).drop("slot_cost")
    inside = Window.partitionBy(*group, "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("spent_before_slot") + F.coalesce(F.sum(cost).over(inside), F.lit(0.0))
    return (
        calls.join(before_slot, [*group, "slot"])
        .withColumn("spent_before", spent)
        .withColumn("allowed", F.col("spent_before") < budget_usd)
        .drop("spent_before_slot")
    )
