"""Text functions. All are built-in expressions evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space a text collector has to expect, written as one regex class.
# Java's own \s is ASCII only, so NBSP and friends are listed.
_WS_WIDE = "\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WS = f"[\\s{_WS_WIDE}]"
NOT_WORD = "[^\\p{L}\\p{N}\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

# Elements whose body is dropped together with the tags.
OPAQUE_ELEMENTS = ("script", "style", "iframe", "object", "embed", "svg")

# Named character references that are decoded; all others stay as they are.
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "hellip": "…",
    "mdash": "—",
    "ndash": "–",
    "rsquo": "’",
    "lsquo": "‘",
    "ldquo": "“",
    "rdquo": "”",
}

# Words that carry no meaning for title similarity.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are",
    "at", "by", "from", "as", "be", "it", "that", "this", "new", "says", "said",
    "ที่", "และ", "ของ", "ใน", "กับ", "เป็น", "ได้", "ให้", "จาก", "มี", "ไม่", "จะ",
)

ELLIPSIS = "…"
MAX_CODE_POINT = 0x10FFFF


def blank_to_null(c: Column) -> Column:
    """Treat null, empty and all-blank text alike, as the collectors do."""
    return F.nullif(trim_ws(c), F.lit(""))


def first_text(*cols: Column) -> Column:
    """First column that holds non-blank text (A3)."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def trim_ws(c: Column) -> Column:
    """White space removed at both ends. A text is searched only if one of its ends may be white space."""
    # ``$`` also stands before a last line break, and U+0085 is one without being in the class.
    end = f"[\\s{_WS_WIDE}\\x85]"

    def trimmed(t: Column) -> Column:
        open_end = F.substring(t, 1, 1).rlike(WS) | F.substring(t, -1, 1).rlike(end)
        return F.when(open_end, F.regexp_replace(t, f"^{WS}+|{WS}+$", "")).otherwise(t)

    return let(c, trimmed)


def _spaced(c: Column, others: str) -> Column:
    """Runs of spaces and ``others``, none of them printable ASCII, become one space; ends are trimmed. Single spaces are not touched."""
    return F.trim(F.regexp_replace(c, f"(?![!-~])(?: [ {others}]+|[{others}][ {others}]*)", " "))


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return _spaced(c, f"\\t\\n\\x0B\\f\\r{_WS_WIDE}")


def remove_control_chars(c: Column) -> Column:
    """C0, DEL and C1 characters become spaces."""
    return F.regexp_replace(c, "[\\x00-\\x1F\\x7F-\\x9F]", " ")


def has_control_or_space(c: Column) -> Column:
    """True if any character is a control character or a space (C4)."""
    return c.rlike("[\\x00-\\x20\\x7F]")


def truncate(c: Column, max_chars: int | None) -> Column:
    """At most ``max_chars`` characters, cut text ends in an ellipsis (C6). ``None`` keeps all."""
    if max_chars is None:
        return c
    cut = F.regexp_replace(F.substring(c, 1, max(0, max_chars - 1)), f"{WS}+$", "")
    return F.when(F.length(c) <= max_chars, c).otherwise(F.concat(cut, F.lit(ELLIPSIS)))


def replace_each(c: Column, pattern: str, decode: Callable[[Column], Column]) -> Column:
    """Replace every match by ``decode(match)`` in a single pass over the text.

    The text between matches and the decoded matches are interleaved, so a decoded match can
    never be matched again.
    """
    pieces = F.zip_with(
        F.split(c, pattern, -1),
        F.regexp_extract_all(c, F.lit(pattern), 0),
        lambda between, match: F.concat(between, F.coalesce(decode(match), F.lit(""))),
    )
    return F.array_join(pieces, "")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def replace_each_once(c: Column, pattern: str, decode: Callable[[Column], Column]) -> Column:
    """``replace_each`` for an input that is itself an expression: evaluated once, skipped if unmatched."""
    return let(c, lambda t: F.when(t.rlike(pattern), replace_each(t, pattern, decode)).otherwise(t))


def code_point_to_text(cp: Column) -> Column:
    """One character for a code point; empty for control characters and values out of range."""
    as_utf32 = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return (
        F.when(cp.isNull() | (cp < 0) | (cp > MAX_CODE_POINT), F.lit(""))
        .when((cp < 0x20) & (cp != 0x09) & (cp != 0x0A), F.lit(""))
        .when(cp.between(0xD800, 0xDFFF), F.lit("�"))
        .otherwise(as_utf32)
    )


def decode_entities(c: Column) -> Column:
    """Hexadecimal, then decimal, then named references, each in one pass."""

    def hex_ref(m: Column) -> Column:
        digits = F.regexp_extract(m, "^&#[xX]0*([0-9a-fA-F]*);$", 1)
        value = F.when(F.length(digits) <= 8, F.conv(F.concat(F.lit("0"), digits), 16, 10))
        return code_point_to_text(value.cast("bigint"))

    def dec_ref(m: Column) -> Column:
        digits = F.regexp_extract(m, "^&#0*([0-9]*);$", 1)
        value = F.when(F.length(digits) <= 10, F.concat(F.lit("0"), digits))
        return code_point_to_text(value.cast("bigint"))

    named = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def named_ref(m: Column) -> Column:
        return F.element_at(named, F.lower(F.regexp_extract(m, "^&([a-zA-Z]+);$", 1)))

    names = "|".join(NAMED_ENTITIES)
    passes = (
        ("&#[xX][0-9a-fA-F]+;", hex_ref),
        ("&#[0-9]+;", dec_ref),
        (f"(?i)&(?:{names});", named_ref),
    )

    def run(text: Column) -> Column:
        for pattern, decode in passes:
            text = replace_each_once(text, pattern, decode)
        return text

    return let(c, lambda t: F.when(t.contains("&"), run(t)).otherwise(t))


def remove_markup(c: Column) -> Column:
    """Comments, opaque elements with their bodies, and all remaining tags become spaces."""
    return let(c, lambda t: F.when(t.contains("<"), _without_tags(t)).otherwise(t))


def _without_tags(c: Column) -> Column:
    names = "|".join(OPAQUE_ELEMENTS)
    word_end = "(?![A-Za-z0-9_])"
    out = F.regexp_replace(c, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, f"(?is)<({names}){word_end}.*?</\\1{WS}*>", " ")
    out = F.regexp_replace(out, f"(?is)<(?:{names}){word_end}.*", " ")
    out = F.regexp_replace(out, f"(?i)<br{WS}*/?>|</p>", " ")
    return F.regexp_replace(out, "<[^>]*>", " ")


def strip_html(c: Column) -> Column:
    """Markup to plain text (C1). Not idempotent: references are decoded after tag removal."""
    # Control characters would become spaces, and runs of white space one space: one pass does both.
    return F.coalesce(_spaced(decode_entities(remove_markup(c)), f"\\x00-\\x1F\\x7F-\\x9F{_WS_WIDE}"), F.lit(""))


def normalize_words(c: Column) -> Column:
    """Lower case, everything but letters, digits and white space becomes a space.

    Combining marks count as neither letter nor digit.
    """
    return F.regexp_replace(F.lower(c), NOT_WORD, " ")


def spaced_words(c: Column) -> Column:
    """``normalize_words`` with white space collapsed, in one pass: both classes together are all but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z\\p{L}\\p{N}]+", " "))


def tokenize(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words longer than one character that are no stop words, in order."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    words = F.split(normalize_words(c), f"{WS}+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def token_set(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct tokens; the stop words are dropped as a set, not word by word."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    words = F.array_except(F.split(normalize_words(c), f"{WS}+"), stop)
    return F.filter(words, lambda w: F.length(w) > 1)


def trigrams(c: Column) -> Column:
    """Distinct three-character slices of the text without white space."""
    packed = F.regexp_replace(F.lower(c), f"{WS}+", "")
    # Two look-ahead free passes would miss overlaps, so the three phases are cut separately.
    slices = F.concat(
        *[F.regexp_extract_all(F.substring(packed, k, 2147483647), F.lit("(?s).{3}"), 0) for k in (1, 2, 3)]
    )
    return F.coalesce(F.array_distinct(slices), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two sets given as arrays, 0 if either is empty (C20)."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / total)


def similarity(a: Column, b: Column) -> Column:
    """Larger of token and trigram Jaccard, 0 if either text is empty."""
    return F.greatest(jaccard(token_set(a), token_set(b)), jaccard(trigrams(a), trigrams(b)))


def regex_quote(s: str) -> str:
    """Escape regex meta characters (valid for both Java and RE2)."""
    return "".join("\\" + ch if ch in ".*+?^${}()|[]\\" else ch for ch in s)


def is_latin_term(term: str) -> bool:
    return bool(term) and all(" " <= ch <= "~" for ch in term)


def _at_edges(hay_lower: Column, needle: str) -> Column:
    """Test of a lower-case Latin term. The regex starts with the term itself, which is searched fast, and then looks at its edges."""
    term = regex_quote(needle)
    return hay_lower.contains(needle) & hay_lower.rlike(f"{term}(?<![a-z0-9]{term})(?![a-z0-9])")


def contains_term(hay_lower: Column, term: str) -> Column:
    """Term test on lower-cased text (C22): Latin terms at word edges, others as substrings.

    The plain substring test comes first: it is a cheap byte search, and the edge regex only
    runs on the rows that pass it.
    """
    needle = term.lower().strip()
    if not needle:
        return F.lit(False)
    return _at_edges(hay_lower, needle) if is_latin_term(needle) else hay_lower.contains(needle)


def contains_any(hay_lower: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Any of the terms, one test after the other until one holds: a text is read through only for terms that are not in it."""
    return reduce(lambda a, b: a | b, [contains_term(hay_lower, t) for t in terms if t.strip()], F.lit(False))


def strip_highlight(c: Column) -> Column:
    """Remove search highlight markers such as ``{{em}}`` and ``{{eem}}``."""
    return F.regexp_replace(c, "\\{\\{/?e?em\\}\\}", "")


def build_video_snippet(description: Column, channel: Column, views: Column, max_chars: int | None = 400) -> Column:
    """Description, channel and grouped view count (C24). Never contains the search words."""
    text = F.concat(
        F.coalesce(description, F.lit("")),
        F.when(blank_to_null(channel).isNotNull(), F.concat(F.lit(" (ช่อง: "), channel, F.lit(")"))).otherwise(F.lit("")),
        F.when(views.isNotNull(), F.concat(F.lit(" · ยอดวิว "), F.format_number(views, 0), F.lit(" ครั้ง"))).otherwise(F.lit("")),
    )
    return truncate(trim_ws(text), max_chars)


def api_error_reason(body: Column) -> Column:
    """Reason or message of an API error payload; null for good payloads and non-JSON."""
    error = F.get_json_object(body, "$.error")
    reason = blank_to_null(F.get_json_object(body, "$.error.errors[0].reason"))
    message = F.get_json_object(body, "$.error.message")
    text = F.coalesce(
        trim_ws(F.concat(reason, F.lit(": "), F.coalesce(message, F.lit("")))), message, F.lit("error")
    )
    return F.when(error.isNotNull(), text)


def source_group(
    source_id: Column,
    source_name: Column,
    exact: dict[str, str] | None = None,
    prefixes: dict[str, str] | None = None,
) -> Column:
    """Collapse sources to one label by exact id or id prefix, otherwise the source name."""
    exact = {"youtube": "YouTube"} if exact is None else exact
    prefixes = {"pantip": "Pantip"} if prefixes is None else prefixes
    out = None
    for sid, label in exact.items():
        out = (F if out is None else out).when(source_id == sid, F.lit(label))
    for prefix, label in prefixes.items():
        out = (F if out is None else out).when(source_id.startswith(prefix), F.lit(label))
    return source_name if out is None else out.otherwise(source_name)


def filled(template: str, **values: Column | str) -> Column:
    """Text of a template; null if one of its values is."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)
