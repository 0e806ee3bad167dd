"""Range report over stored days (O3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.operators.aggregates import range_errors, range_kpi, range_net, worst_status
from briefloom.operators.ranges import in_dates, merge_items
from briefloom.session import materialize, with_scalars


@dataclass(frozen=True)
class RangeReport:
    items: DataFrame  #: merged stories with their report dates
    kpi: DataFrame
    summary: DataFrame  #: one row: range, status, score, sentiment, day of the narrative
    errors: DataFrame | None


def range_report(
    items: DataFrame,
    day_kpis: DataFrame,
    days: DataFrame,
    dates: DataFrame,
    errors: DataFrame | None = None,
    closure: bool = False,
) -> RangeReport:
    """Stored tables of several days to one report.

    ``items`` (date, ord within the day, item columns), ``day_kpis`` (date, counters of the day),
    ``days`` (date, status, net_impact_score, overall_sentiment and what else the newest day's
    narrative holds), ``dates`` the chosen days. A single day is returned as it was stored; several
    days are merged and counted anew, and the narrative is that of the newest day.
    """
    chosen, stored_days = in_dates(items, dates), in_dates(days, dates)
    listed = None if errors is None else range_errors(in_dates(errors, dates))
    span = stored_days.agg(F.min("date").alias("range_from"), F.max("date").alias("range_to"), F.countDistinct("date").alias("range_days"))
    span = span.withColumns({"is_range": F.col("range_days") > 1, "narrative_from_date": F.col("range_to")})
    carried = [c for c in days.columns if c not in ("date", "status", "net_impact_score", "overall_sentiment")]
    if dates.select("date").distinct().count() == 1:
        whole = chosen.withColumns({"report_dates": F.array("date"), "first_ord": F.col("ord")})
        summary = with_scalars(span, stored_days.select("status", "net_impact_score", "overall_sentiment", *carried))
        return RangeReport(whole, in_dates(day_kpis, dates).drop("date"), summary, listed)
    # Newest day first, then the order within the day.
    ordered = chosen.withColumn("ord", F.struct((-F.unix_date("date")).alias("day"), F.col("ord").alias("place")))
    merged = materialize(merge_items(ordered, closure), "merged")
    kpi = range_kpi(merged, in_dates(day_kpis, dates))
    summary = with_scalars(with_scalars(span, range_net(merged)), worst_status(stored_days))
    if carried:
        newest = stored_days.orderBy(F.desc("date")).limit(1)
        summary = with_scalars(summary, newest.select(*carried))
    return RangeReport(merged, kpi, summary, listed)
