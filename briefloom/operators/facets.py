"""Faceted filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.functions.text import source_group


@dataclass(frozen=True)
class Facets:
    """All conditions are optional and must all hold."""

    verdict: str | None = None
    country: str | None = None
    source: str | None = None
    tier: int | None = None
    category: str | None = None
    channel: str | None = None
    product: str | None = None
    min_impact: int | None = None
    competitor_only: bool = False
    text: str | None = None


def facet_filter(df: DataFrame, f: Facets) -> DataFrame:
    out = df
    if f.verdict:
        out = out.where(F.col("classification") == f.verdict)
    if f.country:
        out = out.where(F.array_contains("affected_countries", f.country))
    if f.source:
        out = out.where(source_group(F.col("source_id"), F.col("source_name")) == f.source)
    if f.tier:
        out = out.where(F.col("source_tier") == f.tier)
    if f.category:
        out = out.where(F.col("news_category") == f.category)
    if f.channel:
        out = out.where(F.array_contains("affected_channels", f.channel))
    if f.product:
        out = out.where(F.array_contains("affected_products", f.product))
    if f.min_impact:
        out = out.where(F.abs("impact_score") >= f.min_impact)
    if f.competitor_only:
        out = out.where(F.size("affected_competitors") > 0)
    needle = (f.text or "").strip().lower()
    if needle:
        fields = [
            F.col("title_local"), F.col("title_original"), F.col("short_summary"), F.col("source_name"),
            F.array_join("affected_competitors", " "), F.array_join("reasoning_summary", " "),
        ]
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in fields]))
        out = out.where(hay.contains(needle))
    return out
