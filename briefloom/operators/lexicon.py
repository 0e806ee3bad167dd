"""Lexicon relevance score (H1-H9).

The lexicon is compiled into column expressions, so the score of a whole table is a chain of
narrow projections: no join, no shuffle, no UDF. For lexicons with thousands of terms use
``term_match.match_terms``, which joins a term table instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.text import contains_any, contains_term
from briefloom.lexicons.model import Lexicon
from briefloom.session import compute_once

EMPTY = "array<string>"

SCORE_COLUMNS = (
    "prefilter_score", "matched_categories", "matched_competitors", "matched_brands", "has_context",
    "is_press_release", "is_sponsored", "hard_excluded", "reasons",
)


def _names(pairs: list[tuple[Column, Column]]) -> Column:
    """Values whose condition holds, in order."""
    if not pairs:
        return F.array().cast(EMPTY)
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in pairs]))


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols, F.lit(0))


def score(
    df: DataFrame,
    lexicon: Lexicon,
    title: str = "title",
    snippet: str = "snippet",
    tier: str | None = "source_tier",
    country: str | None = "source_country",
) -> DataFrame:
    """Add the nine score columns to every row."""
    p = "__lx_"
    hay = F.col(f"{p}hay")
    staged = df.withColumn(f"{p}hay", F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(snippet), F.lit("")))))

    # Stage 1: every text test is evaluated once, in one projection over the text.
    flags = {
        f"{p}excl": contains_any(hay, lexicon.hard_exclude),
        f"{p}ctx": contains_any(hay, lexicon.context_terms),
        f"{p}neg": contains_any(hay, lexicon.negative_context),
        f"{p}geo": contains_any(hay, [n for c in (lexicon.home, *lexicon.markets) for n in c.names]),
        f"{p}press": contains_any(hay, lexicon.press_release_markers),
        f"{p}spons": contains_any(hay, lexicon.sponsored_markers),
    }
    for i, cat in enumerate(lexicon.categories):
        flags[f"{p}cat{i}"] = _sum([contains_term(hay, t.text).cast("int") for t in cat.terms])
    for i, brand in enumerate(lexicon.brands):
        flags[f"{p}brand{i}"] = contains_any(hay, (brand.name, *brand.aliases))
    for i, comp in enumerate(lexicon.competitors):
        flags[f"{p}comp{i}"] = contains_any(hay, comp.aliases)
    staged = compute_once(staged, flags)

    ctx, neg, excl = F.col(f"{p}ctx"), F.col(f"{p}neg"), F.col(f"{p}excl")
    tier_col = F.col(tier) if tier else F.lit(2)
    country_col = F.col(country) if country else F.lit(lexicon.home.code)

    def guarded(i: int) -> Column:
        comp = lexicon.competitors[i]
        named = F.col(f"{p}comp{i}")
        return named & ctx & ~neg if comp.ambiguous or lexicon.guard_all_competitors else named

    foreign_market = country_col.isin([c.code for c in lexicon.markets if c.code != lexicon.home.code])
    foreign_market = F.coalesce(foreign_market, F.lit(False))
    staged = staged.withColumns(
        {
            f"{p}brands": _names([(F.col(f"{p}brand{i}"), F.lit(b.name)) for i, b in enumerate(lexicon.brands)]),
            f"{p}comps": _names([(guarded(i), F.lit(c.name)) for i, c in enumerate(lexicon.competitors)]),
            f"{p}base": _sum(
                [
                    F.when(
                        F.col(f"{p}cat{i}") > 0,
                        F.least(F.lit(c.weight) + (F.col(f"{p}cat{i}") - 1) * c.extra_weight, F.lit(3 * c.weight)),
                    ).otherwise(0)
                    for i, c in enumerate(lexicon.categories)
                ]
                + [F.when(F.col(f"{p}brand{i}"), b.weight).otherwise(0) for i, b in enumerate(lexicon.brands)]
                + [F.when(guarded(i), lexicon.competitor_weight).otherwise(0) for i in range(len(lexicon.competitors))]
                + [
                    F.when(F.col(f"{p}geo"), 4).otherwise(0),
                    F.when(foreign_market, 3).otherwise(0),
                    F.when(tier_col == 1, 4).when(tier_col == 3, -3).otherwise(0),
                ]
            ),
        }
    )
    brands, comps, base = F.col(f"{p}brands"), F.col(f"{p}comps"), F.col(f"{p}base")

    # Stage 2: penalties apply in this order: missing context, then sponsorship, then the floor.
    damped = F.when(ctx, base).otherwise(F.floor(base * F.lit(0.35)).cast("int"))
    final = F.greatest(F.lit(0), damped - F.when(F.col(f"{p}spons"), 4).otherwise(0))
    categories = _names(
        [(F.col(f"{p}cat{i}") > 0, F.lit(c.id)) for i, c in enumerate(lexicon.categories)]
        + [
            (F.size(brands) > 0, F.lit(lexicon.brand_category)),
            (F.size(comps) > 0, F.lit(lexicon.competitor_category)),
            (F.col(f"{p}geo") | foreign_market, F.lit(lexicon.geo_category)),
        ]
    )

    def rejected(i: int, why: str) -> Column:
        return F.lit(f'competitor "{lexicon.competitors[i].name}" ignored: {why}')

    reasons: list[tuple[Column, Column]] = [
        (F.col(f"{p}cat{i}") > 0, F.concat(F.lit(f"category {c.id} x"), F.col(f"{p}cat{i}").cast("string")))
        for i, c in enumerate(lexicon.categories)
    ]
    reasons.append((F.size(brands) > 0, F.concat(F.lit("brands: "), F.array_join(brands, ", "))))
    for i, comp in enumerate(lexicon.competitors):
        named = F.col(f"{p}comp{i}")
        if comp.ambiguous or lexicon.guard_all_competitors:
            reasons.append((named & ~ctx, rejected(i, "no automotive context")))
            reasons.append((named & ctx & neg, rejected(i, "disqualifying context")))
        reasons.append((guarded(i), F.lit(f"competitor: {comp.name}")))
    reasons.append((F.col(f"{p}geo"), F.lit("target country mentioned")))
    reasons.append((~ctx, F.lit("penalty: no automotive context")))
    reasons.append((F.col(f"{p}spons"), F.lit("penalty: sponsored content")))

    none = F.array().cast(EMPTY)
    out = staged.withColumns(
        {
            "prefilter_score": F.when(excl, 0).otherwise(final).cast("int"),
            "matched_categories": F.when(excl, none).otherwise(F.array_distinct(categories)),
            "matched_competitors": F.when(excl, none).otherwise(comps),
            "matched_brands": F.when(excl, none).otherwise(brands),
            "has_context": ~excl & ctx,
            "is_press_release": ~excl & F.col(f"{p}press"),
            "is_sponsored": ~excl & F.col(f"{p}spons"),
            "hard_excluded": excl,
            "reasons": F.when(excl, F.array(F.lit("hard_exclude keyword matched"))).otherwise(_names(reasons)),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(p)])
