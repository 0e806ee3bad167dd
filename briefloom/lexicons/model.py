"""Shapes of the lexicon and rule tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Term:
    text: str
    language: str = "en"
    query: bool = False


@dataclass(frozen=True)
class Category:
    id: str
    weight: int
    terms: tuple[Term, ...]

    @property
    def extra_weight(self) -> int:
        """Weight of every hit after the first."""
        return math.ceil(self.weight / 2)


@dataclass(frozen=True)
class Brand:
    name: str
    aliases: tuple[str, ...] = ()
    priority: bool = False

    @property
    def weight(self) -> int:
        return 5 if self.priority else 3


@dataclass(frozen=True)
class Competitor:
    name: str
    aliases: tuple[str, ...]
    ambiguous: bool = False


@dataclass(frozen=True)
class Country:
    code: str
    names: tuple[str, ...]


@dataclass(frozen=True)
class Lexicon:
    """Everything the relevance score needs."""

    context_terms: tuple[str, ...]
    categories: tuple[Category, ...]
    brands: tuple[Brand, ...] = ()
    competitors: tuple[Competitor, ...] = ()
    negative_context: tuple[str, ...] = ()
    guard_all_competitors: bool = True
    home: Country = Country("TH", ("Thailand", "ไทย"))
    markets: tuple[Country, ...] = ()
    hard_exclude: tuple[str, ...] = ()
    press_release_markers: tuple[str, ...] = ()
    sponsored_markers: tuple[str, ...] = ()
    brand_category: str = "OEM_BRANDS"
    competitor_category: str = "COMPETITOR"
    geo_category: str = "INTERNATIONAL"
    competitor_weight: int = 12
    competitor_qualifiers: tuple[tuple[str, tuple[str, ...]], ...] = ()
    brand_templates: tuple[tuple[str, str], ...] = ()

    def terms_df(self, spark: SparkSession) -> DataFrame:
        """Category terms as a table: one row per term, in configuration order."""
        rows = [
            (c.id, c.weight, t.language, t.text, t.query, ci, ti)
            for ci, c in enumerate(self.categories)
            for ti, t in enumerate(c.terms)
        ]
        return spark.createDataFrame(
            rows, "category_id string, weight int, language string, term string, query boolean, cat_ord int, term_ord int"
        )

    def brands_df(self, spark: SparkSession) -> DataFrame:
        rows = [(b.name, list(b.aliases), b.priority, i) for i, b in enumerate(self.brands)]
        return spark.createDataFrame(rows, "brand string, aliases array<string>, priority boolean, ord int")

    def competitors_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, list(c.aliases), c.ambiguous, i) for i, c in enumerate(self.competitors)]
        return spark.createDataFrame(rows, "competitor string, aliases array<string>, ambiguous boolean, ord int")

    def countries_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c.code, list(c.names), c.code == self.home.code) for c in (self.home, *self.markets)]
        return spark.createDataFrame(rows, "code string, names array<string>, home boolean")


@dataclass(frozen=True)
class Signal:
    """A pattern with its weight (negative for bad news) and the label it adds."""

    pattern: str
    weight: int
    label: str


@dataclass(frozen=True)
class LabelRule:
    id: str
    pattern: str


@dataclass(frozen=True)
class RuleSet:
    """Declarative impact rules (I1-I11). Patterns must be valid in both Java and RE2 syntax."""

    positive: tuple[Signal, ...]
    negative: tuple[Signal, ...]
    dual_pattern: str
    dual_positive_label: str
    dual_negative_label: str
    dual_reason: str
    dual_category: str
    distress_pattern: str
    distress_label: str
    rival_label: str  # {names} is replaced
    rival_reason: str  # {names} is replaced
    damped_reason: str
    no_reason: str
    interpretation: str
    default_action: str
    default_owner: str
    channels: tuple[LabelRule, ...]
    brand_channel: str
    products: tuple[LabelRule, ...]
    category_priority: tuple[str, ...]
    competitor_category: str = "COMPETITOR"
    other_category: str = "OTHER"
    home_language: str = "th"
    secondary_channels: tuple[str, ...] = field(default=("B2B", "B2C"))
    dual_weight: int = 2
