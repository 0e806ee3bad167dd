"""Explicit schemas of the stored and landed tables, as Spark DDL. Nothing is ever inferred."""

RAW_ITEM = (
    "ord bigint, title string, link string, snippet string, published_at timestamp, source_id string, "
    "source_name string, source_tier int, source_country string, language string, unverified boolean, item_kind string"
)
COVERAGE = "struct<source_name: string, url: string, tier: int>"
ACTION = "struct<action: string, owner: string, priority: string, deadline: string>"
REPORT_INDEX = (
    "date date, generated_at timestamp, status string, total bigint, positive bigint, neutral bigint, "
    "negative bigint, net_impact_score double, overall_sentiment string, competitor_alerts bigint"
)
SOURCE_HEALTH = (
    "source_id string, source_name string, ok boolean, item_count bigint, error string, configured boolean"
)

# Value domains of the report tables.
CLASSIFICATIONS = ("positive", "neutral", "negative")
CHANNELS = ("OEM", "B2B", "B2C")
NEWS_CATEGORIES = (
    "AUTO_MARKET", "EV", "AC_CLEANING", "INJECTOR", "TRADING", "COMPETITOR", "OEM_BRANDS", "INTERNATIONAL", "OTHER",
)
TIME_HORIZONS = ("immediate", "1-3 months", "3-12 months", "long-term")
PRIORITIES = ("high", "medium", "low")
DEADLINES = ("today", "within_7_days", "monitor")
DEPARTMENTS = (
    "OEM Sales & Marketing", "B2B Sales & Marketing", "B2C Sales & Marketing", "Graphic & IT", "R&D & QA",
    "Stock & Procurement", "HR", "Finance", "Accounting", "Production", "Service & Maintenance",
    "Business Development", "Business Intelligence",
)
ITEM_KINDS = ("news", "social", "signal")
RUN_STATUSES = ("ok", "degraded", "failed")
URGENCY_LEVELS = ("low", "medium", "high")
