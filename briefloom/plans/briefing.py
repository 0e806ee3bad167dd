"""Daily briefing from published items, rule path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.text import filled
from briefloom.operators.aggregates import sentiment_of, urgency_of
from briefloom.operators.ranking import publish_order, top_by_class
from briefloom.session import with_scalars

_ITEM = ("id", "title_local", "short_summary", "positive_impacts", "negative_impacts", "affected_competitors")


def _gather(top: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A handful of ranked rows as one list, best first."""
    from pyspark.sql import Window

    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    return ranked.agg(F.array_sort(F.collect_list(F.struct("rank", *_ITEM))).alias(name))


def _channels(items: DataFrame, classification: str, name: str) -> DataFrame:
    return (
        items.where(F.col("classification") == classification)
        .select(F.explode("affected_channels").alias("c"))
        .agg(F.array_sort(F.collect_set("c")).alias(name))  # the channel domain has three values
    )


@dataclass(frozen=True)
class BriefingTexts:
    """Wording of a briefing. Braces name the values that are put in."""

    quiet_day: str = "Nothing about {org} passed the filters today. See the source status before reading this as a calm day."
    counts: str = "{total} stories about {org}: {positive} good, {neutral} neutral, {negative} bad."
    score: str = "Net score {net}, {mood}."
    best: str = 'Best news: "{title}".'
    worst: str = 'Watch: "{title}".'
    rivals: str = "{rivals} stories name rivals."
    no_rivals: str = "No story names a rival."
    origin: str = "Written from rules without a model."
    act_on_risk: str = "Check the effect of: {title}"
    risk_reason: str = "bad news of high impact"
    act_on_chance: str = "Follow up: {title}"
    chance_reason: str = "good news with a sales case"
    act_on_rival: str = "Keep an eye on {names}"
    rival_reason: str = "rivals may take market share"
    owners: tuple[str, str, str] = ("Business Intelligence", "Sales", "Business Development")
    revenue_goal: str = "Revenue goal: today's signals {trend}"
    trends: tuple[str, str, str] = ("help", "hurt", "are mixed")
    reach_goal: str = "{stories} stories reach beyond {flagship}"
    note: str = "Have a model or a person confirm this before plans change."
    questions: tuple[str, ...] = ("Does any story today change what we sell first?", "Which customer should hear from us because of it?")


def briefing(items: DataFrame, org: str = "us", flagship: str = "the main channel", texts: BriefingTexts = BriefingTexts()) -> DataFrame:
    """One row: summary, sentiment, urgency, signals, actions, targets. An empty day gives a row too."""
    pos_order = [F.desc("impact_score"), *publish_order()]
    neg_order = [F.asc("impact_score"), *publish_order()]
    rivals = items.where(F.size("affected_competitors") > 0).orderBy(*publish_order()).limit(2)
    broad = F.array_contains("affected_channels", "B2B") | F.array_contains("affected_channels", "B2C")
    base = items.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in ("positive", "neutral", "negative")],
        F.coalesce(F.sum(F.col("impact_score") * (F.col("confidence") / 100.0)), F.lit(0.0)).alias("net"),
        F.count_if(F.size("affected_competitors") > 0).alias("rivals_n"),
        F.count_if(broad).alias("broad_n"),
    )
    for part in (
        _gather(top_by_class(items, "positive"), pos_order, "top_pos"),
        _gather(top_by_class(items, "negative"), neg_order, "top_neg"),
        _gather(rivals, publish_order(), "top_rivals"),
        _channels(items, "positive", "benefiting"),
        _channels(items, "negative", "at_risk"),
    ):
        base = with_scalars(base, part)

    net, rivals_n = F.col("net"), F.col("rivals_n")
    overall = sentiment_of(net)

    def by_sentiment(good: str, bad: str, open_: str) -> Column:
        return F.when(overall == "positive", good).when(overall == "negative", bad).otherwise(open_)

    def first_title(col: str) -> Column:
        return F.get(F.col(col), F.lit(0))["title_local"]

    summary = F.when(F.col("n") == 0, filled(texts.quiet_day, org=org)).otherwise(
        F.concat_ws(
            " ",
            filled(texts.counts, org=org, total=F.col("n"), positive=F.col("positive"), neutral=F.col("neutral"), negative=F.col("negative")),
            filled(texts.score, net=F.format_string("%.1f", net), mood=overall),
            filled(texts.best, title=first_title("top_pos")),
            filled(texts.worst, title=first_title("top_neg")),
            F.when(rivals_n > 0, filled(texts.rivals, rivals=rivals_n)).otherwise(F.lit(texts.no_rivals)),
            F.lit(texts.origin),
        )
    )

    def signals(col: str, impacts: str) -> Column:
        return F.transform(
            F.col(col),
            lambda x: F.struct(
                x["title_local"].alias("title"),
                F.coalesce(F.get(x[impacts], F.lit(0)), x["short_summary"]).alias("detail"),
                F.array(x["id"]).alias("related_ids"),
            ),
        )

    def actions(col: str, text, reason, owner: str, priority: str, deadline: str) -> Column:
        return F.transform(
            F.slice(col, 1, 2),
            lambda x: F.struct(
                text(x).alias("action"),
                reason(x).alias("reason"),
                F.lit(owner).alias("owner"),
                F.lit(priority).alias("priority"),
                F.lit(deadline).alias("deadline"),
                F.array(x["id"]).alias("related_ids"),
            ),
        )

    return base.select(
        summary.alias("executive_summary"),
        overall.alias("overall_sentiment"),
        F.round("net", 2).alias("net_impact_score"),
        urgency_of(net, rivals_n).alias("urgency_level"),
        signals("top_pos", "positive_impacts").alias("opportunity_signals"),
        signals("top_neg", "negative_impacts").alias("risk_signals"),
        actions(
            "top_neg", lambda x: filled(texts.act_on_risk, title=x["title_local"]),
            lambda x: F.coalesce(F.get(x["negative_impacts"], F.lit(0)), F.lit(texts.risk_reason)), texts.owners[0], "high", "today",
        ).alias("actions_today"),
        actions(
            "top_pos", lambda x: filled(texts.act_on_chance, title=x["title_local"]),
            lambda x: F.coalesce(F.get(x["positive_impacts"], F.lit(0)), F.lit(texts.chance_reason)), texts.owners[1], "medium", "within_7_days",
        ).alias("actions_within_7_days"),
        actions(
            "top_rivals", lambda x: filled(texts.act_on_rival, names=F.array_join(x["affected_competitors"], ", ")),
            lambda x: F.lit(texts.rival_reason), texts.owners[2], "medium", "monitor",
        ).alias("actions_to_monitor"),
        F.struct(
            filled(texts.revenue_goal, trend=by_sentiment(*texts.trends)).alias("O1"),
            filled(texts.reach_goal, stories=F.col("broad_n"), flagship=flagship).alias("O2"),
            F.col("benefiting").alias("benefiting_channels"),
            F.col("at_risk").alias("at_risk_channels"),
            F.lit(texts.note).alias("prioritisation_note"),
        ).alias("okr_assessment"),
        F.array(*[F.lit(q) for q in texts.questions]).alias("ceo_questions"),
    )
