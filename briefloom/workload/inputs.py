"""Harness tables as the inputs the operators expect. Everything is derived by Spark from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.lexicons.model import Brand, Category, Competitor, Country, LabelRule, Lexicon, RuleSet, Signal, Term
from briefloom.session import materialize, spread

NOW = "2024-01-31T00:00:00Z"


# Tables whose rows are costly to process; the harness stores each as one file.
TEXT_TABLES = ("documents", "pages")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A harness table; its zoneless times are UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
    return spread(df) if name in TEXT_TABLES else df


def _terms(*texts: str) -> tuple[Term, ...]:
    return tuple(Term(t) for t in texts)


# A lexicon whose words occur in the invented languages of the harness texts.
PROBE_LEXICON = Lexicon(
    context_terms=("with", "avec", "nicht", "para"),
    categories=(
        Category("AUTO_MARKET", 6, _terms("is", "of the", "this", "thing", "onand")),
        Category("EV", 6, _terms("pour", "de la", "les", "èè")),
        Category("AC_CLEANING", 14, _terms("from that", "by this", "ableing", "ingly")),
        Category("INJECTOR", 12, _terms("der die", "auch", "ür", "sich")),
        Category("TRADING", 9, _terms("los", "ción", "que de", "por")),
        Category("OEM_BRANDS", 7, _terms("are", "une", "mit", "con")),
    ),
    brands=(Brand("That", ("thatre",), True), Brand("Oner", ("onening", "ouou")), Brand("Vier", ("éeau", "vi"))),
    competitors=(
        Competitor("Erat", ("erat", "eratre"), True),
        Competitor("Eaux", ("eaux", "ñó"), False),
        Competitor("Der", ("der", "un"), True),
    ),
    negative_context=("by", "sur", "als"),
    guard_all_competitors=False,
    home=Country("TH", ("than", "ไทย")),
    markets=(Country("SG", ("ing", "sing")), Country("PH", ("ph", "él")), Country("VN", ("viet",))),
    hard_exclude=("copyright", "password"),
    press_release_markers=("license", "to the"),
    sponsored_markers=("as", "pas"),
)

PROBE_RULES = RuleSet(
    positive=(
        Signal("ation|ción", 2, "growth"),
        Signal("the [a-z]+ing", 2, "demand"),
        Signal("éeau|ür", 3, "core"),
        Signal("up \\d+", 2, "up"),
    ),
    negative=(
        Signal("token|secret", 3, "leak"),
        Signal("nicht.*sich", 2, "refusal"),
        Signal("ment +de|of on", 2, "decline"),
    ),
    dual_pattern="(^|[^A-Za-z0-9_])this([^A-Za-z0-9_]|$)|plug-?in",
    dual_positive_label="dual plus",
    dual_negative_label="dual minus",
    dual_reason="dual rule",
    dual_category="EV",
    distress_pattern="license|recall",
    distress_label="rival in trouble",
    rival_label="rivals ({names}) move",
    rival_reason="rivals: {names}",
    damped_reason="weak source",
    no_reason="rules only",
    interpretation="rules only",
    default_action="check",
    default_owner="Business Intelligence",
    channels=(LabelRule("OEM", "with|mit"), LabelRule("B2B", "that|avec"), LabelRule("B2C", "onion|para")),
    brand_channel="OEM",
    products=(LabelRule("AC_CLEANING", "her"), LabelRule("FUEL_CLEANING", "oui"), LabelRule("TRADING", "schen")),
    category_priority=("AC_CLEANING", "INJECTOR", "TRADING", "OEM_BRANDS", "AUTO_MARKET", "INTERNATIONAL"),
    home_language="de",
)


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw items: the first line is the title, the whole text the snippet."""
    d = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    tier = (number % 3 + 1).cast("int")
    country = F.when(F.col("lang") == "en", "GLOBAL").when(F.col("lang") == "fr", "SG").when(F.col("lang") == "de", "TH").otherwise("PH")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("?utm_source=x")).alias("link"),
        F.col("text").alias("snippet"),
        F.when(F.col("doc_id") % 11 != 0, F.timestamp_seconds(F.lit(1706659200) - F.col("doc_id") * 600)).alias("published_at"),
        F.col("source").alias("source_id"),
        F.col("source").alias("source_name"),
        tier.alias("source_tier"),
        country.alias("source_country"),
        F.col("lang").alias("language"),
        (tier == 3).alias("unverified"),
        F.when(tier == 3, "social").when(number == 7, "signal").otherwise("news").alias("item_kind"),
    )


def dedup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document items with the keys the deduplication needs; fingerprints cover the whole text."""
    from briefloom.functions.hashing import content_hash, id_from_url
    from briefloom.functions.urls import with_canonical_url

    linked = with_canonical_url(document_items(spark, sf_dir), "link")
    return linked.withColumns(
        {"id": id_from_url(F.col("canonical_url")), "content_hash": content_hash(F.col("title"), F.col("snippet"), None)}
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.operators.lexicon import score

    return score(document_items(spark, sf_dir), PROBE_LEXICON)


def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.operators.classify import classify

    items = scored_documents(spark, sf_dir).withColumn("id", F.col("ord").cast("string"))
    return classify(items, PROBE_RULES)


def analysed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified documents, written as a report table for a query that reads them more than once."""
    return materialize(classified_documents(spark, sf_dir), "analysed")


def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as analysed items of daily reports, the day counted in Bangkok time."""
    from briefloom.functions.dates import date_key

    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    impact = (k % 11 - 5).cast("int")
    return e.select(
        F.col("event_id").alias("ord"),
        "event_id",
        "ts",
        "event_type",
        "user_id",
        date_key(F.col("ts")).alias("date"),
        F.col("event_id").cast("string").alias("id"),
        F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("content_hash"),
        F.concat(F.lit("https://e.example.com/"), "user_id", F.lit("/"), k.cast("string")).alias("canonical_url"),
        (F.col("user_id") % 3 + 1).cast("int").alias("source_tier"),
        F.when(F.col("user_id") % 2 == 0, "TH").otherwise("SG").alias("source_country"),
        impact.alias("impact_score"),
        (F.lit(20) + k % 56).cast("int").alias("confidence"),
        F.when(impact >= 2, "positive").when(impact <= -2, "negative").otherwise("neutral").alias("classification"),
        F.when(F.col("event_type") == "click", "EV").otherwise("OTHER").alias("news_category"),
        F.when(F.col("event_type") == "view", F.array(F.lit("OEM"), F.lit("B2B")))
        .when(F.col("event_type") == "purchase", F.array(F.lit("B2C")))
        .otherwise(F.array().cast("array<string>"))
        .alias("affected_channels"),
        F.when(F.col("event_type") == "signup", F.array(F.lit("Thailand"))).otherwise(F.array(F.lit("Global"))).alias("affected_countries"),
        F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("rival"), (k % 4).cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("affected_competitors"),
        F.struct(
            F.when(impact >= 2, "positive").otherwise("neutral").alias("O1"),
            F.when(impact >= 4, "positive").otherwise("neutral").alias("O2"),
        ).alias("okr_impact"),
        F.when(F.col("event_type") == "error", "social").when(F.col("event_type") == "signup", "signal").otherwise("news").alias("item_kind"),
    )
