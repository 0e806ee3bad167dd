"""URL functions as column expressions.

Intermediate values are bound once (``let``), so the expressions stay small and every part of a
URL is computed once per row. Parity is for ASCII hosts; non-ASCII host names are lower-cased,
not converted to punycode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.text import let, replace_each_once, trim_ws

# Query parameters that only track the visitor.
TRACKING_PREFIXES = ("utm_",)
TRACKING_PARAMS = (
    "fbclid", "gclid", "dclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src",
    "referrer", "source", "cmpid", "campaign_id", "spm", "_ga", "yclid", "oc",
)
TRACKING_REGEX = f"(?i)^(?:{'|'.join(TRACKING_PREFIXES)})|^(?:{'|'.join(TRACKING_PARAMS)})$"

# Aggregator hosts that carry the publisher's link in a ``url`` parameter.
AGGREGATOR_HOSTS = "news\\.(?:url\\.)?google\\.com"

_PARTS = "^(?i:(https?)):[/\\\\]*([^/?#\\\\]*)([^?#]*)(\\?[^#]*)?(#.*)?$"
_AUTHORITY = "^(?:(.*)@)?(\\[[0-9A-Fa-f:.]+\\]|[^:@\\[\\]<>^|%]+)(?::([0-9]*))?$"
_PORT = "0*(?:[0-9]{0,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
_SAFE = (
    "(?i)^https?:[/\\\\]*(?:[^/?#\\\\\\x00-\\x20\\x7F]*@)?(?:\\[[0-9A-Fa-f:.]+\\]|[^/?#\\\\:@\\[\\]<>^|%\\x00-\\x20\\x7F]+)"
    f"(?::{_PORT})?(?:[/?#\\\\][^\\x00-\\x20\\x7F]*)?$"
)
_IS_AGGREGATOR = f"(?i)^https?:[/\\\\]*(?:[^/?#\\\\]*@)?[^/?#\\\\:@]*{AGGREGATOR_HOSTS}(?::[0-9]*)?(?:[/?#\\\\]|$)"
_UNSAFE_IN_PATH = "[^\\x21-\\x7E]|[\"<>`{}]"
_UNSAFE_IN_QUERY = "[^\\x21-\\x7E]|[\"<>']"


def is_safe_url(c: Column) -> Column:
    """True for plain http(s) links; exactly the rows that get a sanitised and a canonical URL."""
    return F.coalesce(trim_ws(c).rlike(_SAFE), F.lit(False))


def _cut(c: Column, pattern: str, groups: int) -> Column:
    """Groups of a pattern that matches as an array, in one regex pass."""
    return F.split(F.regexp_replace(c, pattern, "\n".join(f"${i}" for i in range(1, groups + 1))), "\n", -1)


def _percent_encode(c: Column, unsafe: str) -> Column:
    return replace_each_once(c, unsafe, lambda m: F.replace(F.url_encode(m), F.lit("+"), F.lit("%20")))


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; only evaluated for paths that have one."""

    def resolve(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        open_end = F.element_at(segments, -1).isin(".", "..")
        tail = F.when(open_end, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))

    split = F.split(F.substring(path, 2, 2147483647), "/", -1)
    return F.when(path.rlike("/\\.{1,2}(/|$)"), let(split, resolve)).otherwise(path)


def _parse(safe: Column) -> Column:
    """Parts of a safe URL: scheme, user, host, port, path, query, fragment."""

    def with_authority(parts: Column) -> Column:
        def build(auth: Column) -> Column:
            path = F.replace(F.get(parts, F.lit(2)), F.lit("\\"), F.lit("/"))
            rooted = F.when(path == "", F.lit("/")).otherwise(path)
            return F.struct(
                F.lower(F.get(parts, F.lit(0))).alias("scheme"),
                F.nullif(F.get(auth, F.lit(0)), F.lit("")).alias("user"),
                F.lower(F.get(auth, F.lit(1))).alias("host"),
                F.nullif(F.get(auth, F.lit(2)), F.lit("")).cast("int").alias("port"),
                _percent_encode(let(rooted, _resolve_dots), _UNSAFE_IN_PATH).alias("path"),
                F.get(parts, F.lit(3)).alias("query"),
                F.get(parts, F.lit(4)).alias("fragment"),
            )

        return let(_cut(F.get(parts, F.lit(1)), _AUTHORITY, 3), build)

    return let(_cut(safe, _PARTS, 5), with_authority)


def _authority(u: Column, host: Column, drop_port: Column) -> Column:
    return F.concat(
        F.coalesce(F.concat(u["user"], F.lit("@")), F.lit("")),
        host,
        F.when(u["port"].isNull() | drop_port, F.lit("")).otherwise(F.concat(F.lit(":"), u["port"].cast("string"))),
    )


def _on_safe(c: Column, build: Callable[[Column], Column]) -> Column:
    return let(trim_ws(c), lambda raw: F.when(raw.rlike(_SAFE), build(raw)))


def sanitize_url(c: Column) -> Column:
    """The serialised URL, or null unless it is a plain http(s) link."""

    def serialise(u: Column) -> Column:
        default_port = ((u["scheme"] == "http") & (u["port"] == 80)) | ((u["scheme"] == "https") & (u["port"] == 443))
        return F.concat(
            u["scheme"],
            F.lit("://"),
            _authority(u, u["host"], F.coalesce(default_port, F.lit(False))),
            u["path"],
            _percent_encode(u["query"], _UNSAFE_IN_QUERY),
            u["fragment"],
        )

    return _on_safe(c, lambda raw: let(_parse(raw), serialise))


def _canonical_query(query: Column) -> Column:
    """Parameters without the tracking ones, sorted by name, form-encoded; empty if none is left."""

    def decode(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))

    raw = F.filter(F.split(F.substring(query, 2, 2147483647), "&", -1), lambda kv: kv != "")
    pairs = F.transform(
        raw,
        lambda kv, i: F.struct(
            decode(F.substring_index(kv, "=", 1)).alias("k"),
            i.alias("pos"),
            F.when(kv.contains("="), decode(F.regexp_replace(kv, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda x: ~x["k"].rlike(TRACKING_REGEX)))
    encoded = F.transform(kept, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"])))
    text = F.regexp_replace(F.array_join(encoded, "&"), "^(?=.)", "?")
    return F.when(F.length(query) <= 1, F.lit("")).otherwise(text)


def _unwrapped(raw: Column) -> Column:
    """Publisher link of an aggregator URL where it is in the parameters, else the URL itself."""
    target = F.try_url_decode(F.nullif(F.regexp_extract(raw, "^[^?#]*\\?(?:[^#]*&)??url=([^&#]*)", 1), F.lit("")))
    unwrap = let(trim_ws(target), lambda t: F.when(t.rlike(_SAFE), t).otherwise(raw))
    return F.when(raw.rlike(_IS_AGGREGATOR), unwrap).otherwise(raw)


def canonical_url(c: Column) -> Column:
    """The form used to find duplicates (C8), null for unsafe or unparsable links.

    https, lower-case host without ``www.``, no default port, no fragment, no tracking
    parameters, sorted parameters, one trailing slash removed; aggregator links are unwrapped.
    """

    def serialise(u: Column) -> Column:
        host = F.regexp_replace(u["host"], "^www\\.", "")
        base = F.concat(_authority(u, host, u["port"].isin(80, 443)), u["path"])
        return F.concat(F.lit("https://"), F.regexp_replace(base, "([^/])/$", "$1"), _canonical_query(u["query"]))

    return _on_safe(c, lambda raw: let(_parse(let(raw, _unwrapped)), serialise))


def with_canonical_url(df: DataFrame, url: str, out: str = "canonical_url") -> DataFrame:
    """Rows with a safe link and their canonical URL. The cheap test runs first and on its own."""
    return df.where(is_safe_url(F.col(url))).withColumn(out, canonical_url(F.col(url)))


def with_sanitized_url(df: DataFrame, url: str, out: str) -> DataFrame:
    """Rows with a safe link and their serialised URL."""
    return df.where(is_safe_url(F.col(url))).withColumn(out, sanitize_url(F.col(url)))


def domain_of(c: Column) -> Column:
    """Lower-case host without ``www.``, empty when there is none."""
    host = F.regexp_extract(
        trim_ws(c), "^[A-Za-z][A-Za-z0-9+.\\-]*:[/\\\\]{2,}(?:[^/?#\\\\@]*@)?(\\[[^\\]]*\\]|[^/?#\\\\:@]*)", 1
    )
    return F.coalesce(F.regexp_replace(F.lower(host), "^www\\.", ""), F.lit(""))


def origin_of(c: Column) -> Column:
    """``scheme://host[:port]`` of a sanitised URL."""
    return F.nullif(F.regexp_extract(c, "^([a-z]+://[^/?#]*)", 1), F.lit(""))


def path_of(c: Column) -> Column:
    """Path and query of a sanitised URL."""
    return F.regexp_extract(c, "^[a-z]+://[^/?#]*([^#]*)", 1)
