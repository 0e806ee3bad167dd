"""JSON embedded in HTML pages to forum topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.dates import parse_epoch_or_date
from briefloom.functions.text import strip_highlight, strip_html, truncate
from briefloom.functions.urls import with_sanitized_url
from briefloom.session import compute_once

_SCRIPT = '(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'
TOPIC = (
    "struct<id: string, topic_id: string, title: string, detail: string, comment: string, url: string, "
    "created_time: string, last_reply_time: string>"
)


def embedded_json(html: Column) -> Column:
    """Text of the embedded data script, null if the page has none."""
    return F.nullif(F.regexp_extract(html, _SCRIPT, 1), F.lit(""))


#: Levels below the whole document that are searched.
MAX_DEPTH = 8
_NODE = "struct<place: array<int>, text: string>"


def _is_container(value: Column) -> Column:
    """Objects and arrays; a text that merely looks like one is not."""
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")


def _is_array(text: Column) -> Column:
    return F.regexp_like(text, F.lit("^\\s*\\["))


def _parts(text: Column) -> Column:
    """Entries of an object or an array as (text, value), in the order of the document."""

    def parsed(kind: str) -> Column:
        entries = F.map_values(F.from_json(text, f"map<string,{kind}>"))
        return F.when(_is_array(text), F.from_json(text, f"array<{kind}>")).otherwise(entries)

    return F.arrays_zip(parsed("string").alias("text"), parsed("variant").alias("value"))


def _is_topic_list(text: Column) -> Column:
    """An array whose first entry is an object with a title and an identifier."""
    first = F.get(F.from_json(text, "array<string>"), 0)
    keys = F.json_object_keys(first)
    named = F.array_contains(keys, "title") & (F.array_contains(keys, "id") | F.array_contains(keys, "topic_id"))
    real = F.schema_of_variant(F.get(F.from_json(text, "array<variant>"), 0)).startswith("OBJECT")
    return _is_array(text) & F.coalesce(real & named, F.lit(False))


def with_topic_list(docs: DataFrame, doc: str, name: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Add the first topic list of JSON texts whose layout is not known, as JSON text; null if there is none.

    The containers of one level become those of the next, down to ``max_depth``; a place is the entries that lead to it,
    so the first list in document order has the least place. Entries keep the order of the text, and their variant
    values tell a real array from a text that looks like one. Texts that are no JSON have no list.
    """
    whole = F.try_parse_json(doc)
    root = F.array(F.struct(F.array().cast("array<int>").alias("place"), F.col(doc).alias("text")))
    front = F.when(whole.isNotNull() & _is_container(whole), root).otherwise(F.array().cast(f"array<{_NODE}>"))
    state = compute_once(docs, {"__found": F.lit(None).cast(_NODE), "__front": front})
    for depth in range(max_depth + 1):
        hits = F.filter("__front", lambda n: _is_topic_list(n["text"]))
        state = compute_once(state, {"__hits": hits})
        found = F.array_min(F.concat(F.array("__found"), "__hits"))
        rest = F.array_except(F.col("__front"), F.col("__hits"))
        below = F.flatten(
            F.transform(
                rest,
                lambda n: F.transform(
                    F.filter(
                        F.transform(_parts(n["text"]), lambda p, i: F.struct(F.concat(n["place"], F.array(i)).alias("place"), p["text"].alias("text"), p["value"].alias("value"))),
                        lambda c: F.coalesce(_is_container(c["value"]), F.lit(False)),
                    ),
                    lambda c: F.struct(c["place"].alias("place"), c["text"].alias("text")),
                ),
            )
        )
        changes = {"__found": found} if depth == max_depth else {"__found": found, "__front": below}
        state = compute_once(state, changes)
    return state.select(*docs.columns, F.col("__found.text").alias(name))


def topics_of(listed: Column) -> Column:
    """Topics of a list given as JSON text; entries that are no objects are left out."""
    objects = F.filter(
        F.arrays_zip(F.from_json(listed, "array<string>").alias("text"), F.from_json(listed, "array<variant>").alias("value")),
        lambda e: F.coalesce(F.schema_of_variant(e["value"]).startswith("OBJECT"), F.lit(False)),
    )
    return F.transform(objects, lambda e: F.from_json(e["text"], TOPIC))


def topics_at(doc: Column, path: str) -> Column:
    """Topic list at a known JSON path: stays in the JVM."""
    return F.from_json(F.get_json_object(doc, path), f"array<{TOPIC}>")


def forum_topics(pages: DataFrame, html: str = "html", path: str | None = None, max_items: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pages to topic rows, in page order. Without a known ``path`` the topic list is searched for, down to ``max_depth``."""
    keep = [c for c in pages.columns if c != html]
    docs = pages.select(*keep, embedded_json(F.col(html)).alias("__doc")).where(F.col("__doc").isNotNull())
    if path is None:
        topics = with_topic_list(docs, "__doc", "__list", max_depth).withColumn("__topics", topics_of(F.col("__list")))
    else:
        topics = docs.withColumn("__topics", topics_at(F.col("__doc"), path))
    listed = F.col("__topics") if max_items is None else F.slice("__topics", 1, max_items)
    return topics.select(*keep, F.posexplode(listed).alias("entry_pos", "t")).select(*keep, "entry_pos", "t.*")


def topic_items(
    topics: DataFrame, keep: tuple[str, ...], label: Column, kind: Column, site: str, topic_url: str, now: Column | None = None,
    max_snippet_chars: int | None = None,
) -> DataFrame:
    """Topics to raw items (A10). The label goes into the source name, never into scored text.

    ``site``: name of the forum; ``topic_url``: address of a topic without its identifier, for topics that give none.
    """
    topic_id = F.coalesce("id", "topic_id")
    rows = compute_once(
        topics,
        {
            "topic": topic_id,
            "title": strip_html(strip_highlight(F.col("title"))),
            "__link": F.coalesce("url", F.concat(F.lit(topic_url), topic_id)),
            "__body": strip_html(strip_highlight(F.coalesce("detail", "comment"))),
            "published_at": parse_epoch_or_date(F.coalesce("created_time", "last_reply_time"), now),
            "__label": label,
            "__kind": kind,
        },
    ).where((F.coalesce("topic", F.lit("")) != "") & (F.col("title") != ""))
    linked = with_sanitized_url(rows, "__link", "link")
    return linked.select(
        *keep,
        "entry_pos",
        "title",
        "link",
        truncate(F.col("__body"), max_snippet_chars).alias("snippet"),
        "published_at",
        F.concat(F.lit(f"{site.lower()}:"), F.col("__label")).alias("source_id"),
        F.concat(F.lit(f"{site} ("), F.col("__kind"), F.lit(" "), F.col("__label"), F.lit(")")).alias("source_name"),
        F.lit(3).alias("source_tier"),
        F.lit("TH").alias("source_country"),
        F.lit("th").alias("language"),
        F.lit(True).alias("unverified"),
        F.lit("social").alias("item_kind"),
    )
