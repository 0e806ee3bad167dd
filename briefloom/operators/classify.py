"""Rule-based impact classification (I1-I11): one chain of projections, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.numbers import clamp, round_int, trunc
from briefloom.functions.text import truncate
from briefloom.lexicons.model import RuleSet, Signal
from briefloom.schemas import ACTION
from briefloom.session import compute_once

TEXTS = "array<string>"

ANALYSIS_COLUMNS = (
    "title_local", "short_summary", "classification", "impact_score", "confidence", "relevance_score",
    "news_category", "affected_channels", "affected_products", "affected_countries", "affected_competitors",
    "okr_impact", "positive_impacts", "negative_impacts", "reasoning_summary", "business_interpretation",
    "recommended_actions", "time_horizon",
)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iu){pattern}")


def _labels(pairs: list[tuple[Column, Column | str]]) -> Column:
    values = [F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in pairs]
    return F.array_compact(F.array(*values)) if values else F.array().cast(TEXTS)


def _template(text: str, names: Column) -> Column:
    before, _, after = text.partition("{names}")
    return F.concat(F.lit(before), names, F.lit(after))


def verdict(impact: Column) -> Column:
    """Two points or more either way decide."""
    return F.when(impact >= 2, "positive").when(impact <= -2, "negative").otherwise("neutral")


def relevance(prefilter_score: Column) -> Column:
    """Calibrated relevance 0..100 of a prefilter score."""
    scaled = round_int(F.lit(12.0) + prefilter_score * F.lit(3.1))
    return F.when(prefilter_score == 0, 0).otherwise(clamp(scaled, 0, 100)).cast("int")


def confidence(dated: Column, tier: Column, snippet_chars: Column, dual: Column) -> Column:
    """Rules are never more than 75 percent sure."""
    points = (
        F.lit(45)
        + F.when(dated, 8).otherwise(0)
        + F.when(tier == 1, 10).when(tier == 3, -12).otherwise(0)
        + F.when(snippet_chars > 120, 5).otherwise(0)
        - F.when(dual, 5).otherwise(0)
    )
    return clamp(points, 10, 75).cast("int")


def classify(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Add the analysis columns to normalised items."""
    p = "__cl_"
    text = F.col(f"{p}text")
    out = df.withColumn(f"{p}text", F.concat_ws(" ", "title", "snippet"))

    # Stage 1: one column per pattern, so every pattern runs once per row.
    def flags(kind: str, signals: tuple[Signal, ...]) -> dict[str, Column]:
        return {f"{p}{kind}{i}": matches(text, s.pattern) for i, s in enumerate(signals)}

    out = compute_once(
        out,
        {
            **flags("pos", rules.positive),
            **flags("neg", rules.negative),
            f"{p}dual": matches(text, rules.dual_pattern),
            f"{p}distress": matches(text, rules.distress_pattern),
            **{f"{p}chan{i}": matches(text, r.pattern) for i, r in enumerate(rules.channels)},
            **{f"{p}prod{i}": matches(text, r.pattern) for i, r in enumerate(rules.products)},
            f"{p}rival": F.size("matched_competitors") > 0,
            f"{p}names": F.array_join("matched_competitors", ", "),
            f"{p}weak": (F.col("source_tier") == 3) | F.col("unverified"),
        },
    )
    dual, distress, rival, weak = (F.col(f"{p}{n}") for n in ("dual", "distress", "rival", "weak"))
    names = F.col(f"{p}names")
    pos = [(F.col(f"{p}pos{i}"), s) for i, s in enumerate(rules.positive)]
    neg = [(F.col(f"{p}neg{i}"), s) for i, s in enumerate(rules.negative)]

    points = [F.when(c, s.weight).otherwise(0) for c, s in pos]
    points += [F.when(c, -s.weight).otherwise(0) for c, s in neg]
    points.append(F.when(rival & distress, 2).when(rival, -3).otherwise(0))
    # The dual rule adds and subtracts the same weight; both sides are listed, the net is zero.
    points += [F.when(dual, rules.dual_weight).otherwise(0), F.when(dual, -rules.dual_weight).otherwise(0)]

    chans = _labels([(F.col(f"{p}chan{i}"), r.id) for i, r in enumerate(rules.channels)])
    out = out.withColumns(
        {
            f"{p}score": reduce(lambda a, b: a + b, points),
            f"{p}channels": chans,
            f"{p}positives": _labels(
                [(c, s.label) for c, s in pos]
                + [(rival & distress, rules.distress_label), (dual, rules.dual_positive_label)]
            ),
            f"{p}negatives": _labels(
                [(c, s.label) for c, s in neg]
                + [(rival & ~distress, _template(rules.rival_label, names)), (dual, rules.dual_negative_label)]
            ),
            f"{p}reasons": _labels(
                [(rival, _template(rules.rival_reason, names)), (dual, rules.dual_reason), (weak, rules.damped_reason)]
            ),
        }
    )
    score, reasons = F.col(f"{p}score"), F.col(f"{p}reasons")
    damped = F.when(weak, trunc(score * F.lit(0.6))).otherwise(score)
    channels = F.when(
        (F.size(f"{p}channels") == 0) & (F.size("matched_brands") > 0), F.array(F.lit(rules.brand_channel))
    ).otherwise(F.col(f"{p}channels"))
    cats = F.col("matched_categories")
    ranked = F.filter(F.array(*[F.lit(c) for c in rules.category_priority]), lambda c: F.array_contains(cats, c))
    out = out.withColumns(
        {
            "impact_score": clamp(damped, -5, 5).cast("int"),
            "relevance_score": relevance(F.col("prefilter_score")),
            "confidence": confidence(F.col("published_at").isNotNull(), F.col("source_tier"), F.length("snippet"), dual),
            "affected_channels": channels,
        }
    )
    impact = F.col("impact_score")
    strong = F.abs(impact) >= 3
    out = out.withColumn("classification", verdict(impact))
    direction = F.col("classification")
    broad = reduce(lambda a, b: a | b, [F.array_contains("affected_channels", c) for c in rules.secondary_channels])
    summary_source = F.when(F.col("snippet") != "", F.col("snippet")).otherwise(F.col("title"))
    country = F.when(F.col("source_country") == "GLOBAL", "Global").otherwise(F.col("source_country"))
    out = out.withColumns(
        {
            "title_local": F.when(F.col("language") == rules.home_language, F.col("title")).otherwise(
                F.concat(F.lit("[EN] "), F.col("title"))
            ),
            "short_summary": truncate(summary_source, 300),
            "news_category": F.when(rival, rules.competitor_category)
            .when(dual, rules.dual_category)
            .otherwise(F.coalesce(F.get(ranked, F.lit(0)), F.get(cats, F.lit(0)), F.lit(rules.other_category))),
            "affected_products": _labels([(F.col(f"{p}prod{i}"), r.id) for i, r in enumerate(rules.products)]),
            "affected_countries": F.array(country),
            "affected_competitors": F.col("matched_competitors"),
            "okr_impact": F.struct(
                direction.alias("O1"), F.when(broad, direction).otherwise(F.lit("neutral")).alias("O2")
            ),
            "positive_impacts": F.slice(f"{p}positives", 1, 5),
            "negative_impacts": F.slice(f"{p}negatives", 1, 5),
            "reasoning_summary": F.when(F.size(reasons) == 0, F.array(F.lit(rules.no_reason))).otherwise(
                F.slice(reasons, 1, 3)
            ),
            "business_interpretation": F.lit(rules.interpretation),
            "recommended_actions": F.array(
                F.struct(
                    F.lit(rules.default_action).alias("action"),
                    F.lit(rules.default_owner).alias("owner"),
                    F.when(strong, "high").otherwise("medium").alias("priority"),
                    F.when(strong, "today").otherwise("monitor").alias("deadline"),
                )
            ).cast(f"array<{ACTION}>"),
            "time_horizon": F.when(dual, "long-term").when(rival, "immediate").otherwise("1-3 months"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(p)])
