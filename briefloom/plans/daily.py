"""Daily pipeline (O1) and collect-only funnel (O2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.lexicons.model import Lexicon, RuleSet
from briefloom.operators import store
from briefloom.operators.aggregates import daily_kpi, error_log, run_status
from briefloom.operators.counters import StageCounts
from briefloom.operators.dedup import DedupOptions, DedupResult, deduplicate
from briefloom.operators.enrich import BatchModel, EnrichOptions, enrich, origin_counts
from briefloom.operators.manifest import DayStore
from briefloom.operators.normalize import NormalizeOptions, RecencyOptions, filter_by_recency, is_recent, normalize_items
from briefloom.operators.ranking import candidate_preview, gate, publish_cut, publish_ranking
from briefloom.operators.quality import ANALYSIS_RULES
from briefloom.operators.store import RETENTION_DAYS
from briefloom.plans.briefing import briefing
from briefloom.schemas import REPORT_INDEX
from briefloom.session import materialize, with_scalars


@dataclass(frozen=True)
class DailyOptions:
    normalize: NormalizeOptions = field(default_factory=NormalizeOptions)
    recency: RecencyOptions = field(default_factory=RecencyOptions)
    dedup: DedupOptions = field(default_factory=DedupOptions)
    enrich: EnrichOptions = field(default_factory=EnrichOptions)
    min_prefilter_score: int = 8
    min_relevance: int = 40


@dataclass(frozen=True)
class Funnel:
    collected: DataFrame
    normalized: DataFrame
    recent: DataFrame
    dedup: DedupResult
    candidates: DataFrame
    seen: StageCounts

    def counts(self) -> DataFrame:
        """Rows of each stage, as they were counted while the tables were written. No table is read for it."""
        return self.seen.row(self.collected.sparkSession)


@dataclass(frozen=True)
class DailyReport:
    """The tables of one report day."""

    items: DataFrame
    coverage: DataFrame
    kpi: DataFrame
    briefing: DataFrame
    dedup_stats: DataFrame
    funnel: DataFrame
    origins: DataFrame
    errors: DataFrame  #: (ord, scope, message) of failed model calls and answers
    fresh: DataFrame  #: cache rows of new model answers, without their time


def collect_funnel(raw: DataFrame, now: Column, lexicon: Lexicon, options: DailyOptions = DailyOptions()) -> Funnel:
    """Normalise, drop stale items, deduplicate, gate. Nothing is enriched.

    The normalised items are written once: the deduplication and the report read them. Every stage is counted by a write.
    """
    seen = StageCounts()
    normal = normalize_items(seen.at(raw, total_collected=None), lexicon, now, options.normalize)
    fresh = is_recent(now, options.recency)
    normalized = materialize(seen.at(normal, after_normalize=None, after_recency=fresh), "normalized")
    recent = filter_by_recency(normalized, now, options.recency)
    passes = F.col("prefilter_score") >= options.min_prefilter_score
    dedup = deduplicate(recent, options.dedup, watch=lambda items: seen.at(items, after_dedup=None, after_prefilter=passes))
    return Funnel(raw, normalized, recent, dedup, gate(dedup.items, options.min_prefilter_score), seen)


def collect_preview(funnel: Funnel, k: int = 10) -> DataFrame:
    return candidate_preview(funnel.candidates, k)


def run_daily(
    raw: DataFrame,
    now: Column,
    lexicon: Lexicon,
    rules: RuleSet,
    cache: DataFrame | None = None,
    model: BatchModel | None = None,
    options: DailyOptions = DailyOptions(),
    budget: Callable[[DataFrame], DataFrame] | None = None,
) -> DailyReport:
    """Raw items to the report tables of one day. Without a model every verdict comes from the rules.

    ``budget`` decides which model calls may be made (see ``enrich``).
    """
    funnel = collect_funnel(raw, now, lexicon, options)
    done = enrich(funnel.candidates, rules, cache, model, options.enrich, budget)
    analyzed = materialize(done.items, "analyzed")
    published = publish_cut(analyzed, options.min_relevance)
    counts = funnel.counts()
    return DailyReport(
        items=publish_ranking(published),
        coverage=funnel.dedup.coverage,
        kpi=daily_kpi(published, funnel=counts),
        briefing=briefing(published),
        dedup_stats=funnel.dedup.stats,
        funnel=counts,
        origins=origin_counts(analyzed),
        errors=done.errors,
        fresh=done.fresh,
    )


def index_entry(report: DailyReport, health: DataFrame, errors: DataFrame, day: Column, now: Column) -> DataFrame:
    """Row of the history index for a finished report."""
    row = report.kpi.select(
        day.alias("date"),
        now.alias("generated_at"),
        F.col("published").alias("total"),
        "positive", "neutral", "negative", "competitor_alerts",
    )
    row = with_scalars(row, report.briefing.select("net_impact_score", "overall_sentiment"))
    status = run_status(health, errors)
    row = with_scalars(row, status.select("status"))
    return row.select(
        "date", "generated_at", "status", "total", "positive", "neutral", "negative",
        "net_impact_score", "overall_sentiment", "competitor_alerts",
    )


#: Report tables, one partition per day.
DAY_TABLES = ("items", "coverage", "kpi", "briefing", "health", "errors")


def save_day(
    report: DailyReport, root: str, day: date, now: Column, health: DataFrame, errors: DataFrame | None = None, keep: int = RETENTION_DAYS,
    staged: Callable[[str], None] = lambda name: None,
) -> list[date]:
    """Finish a day (O1): its tables, its row of the history index, the days that expire, and the cache, all shown at once.

    ``health``: (source_id, source_name, ok, item_count, error, configured). ``errors``: (ord, scope, message) of the
    collectors, beside those of the model. A day that is saved again replaces what was stored. Returns the days that
    went out of view. Items that break the schema stop the job. Everything is staged first, and ``staged`` is called with
    the name of each table; a job that ends before the last write leaves all readers with the former state.
    """
    spark = report.items.sparkSession
    tables_of = DayStore(spark, root)
    change = tables_of.begin()

    def put(name: str, df: DataFrame, of: date | None = None, rules: tuple = ()) -> None:
        change.put(name, df, of, rules)
        staged(name)

    log = report.errors if errors is None else errors.select("ord", "scope", "message").unionByName(report.errors)
    tables = {
        "items": report.items.drop("saved_at"), "coverage": report.coverage, "kpi": report.kpi, "briefing": report.briefing, "health": health, "errors": error_log(log),
    }
    for name in DAY_TABLES:
        put(name, tables[name], day, ANALYSIS_RULES if name == "items" else ())
    entry = index_entry(report, health, log, F.lit(day), now)
    index = materialize(store.upsert_index(tables_of.read("index", REPORT_INDEX), entry, keep), "index")
    put("index", index.coalesce(1))
    fresh = report.fresh.withColumn("saved_at", now)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema.fields)
    put("cache", store.upsert_cache(store.evict_expired(tables_of.read("cache", schema), now), fresh))
    gone = change.keep_days({r["date"] for r in index.select("date").collect()})  # at most ``keep`` days
    change.commit()
    return gone
