"""Stored queries: expansion of the lexicon (H10, D7, D8, E8, N2) and matching against documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.lexicons.model import Lexicon
from briefloom.operators.dedup import first_by
from briefloom.operators.graph import salted_lookup
from briefloom.session import materialize, with_scalars


def _place(number: int, *parts: Column) -> Column:
    """Place of a query in the order of all lists: the list, then up to three numbers of any size."""
    three = [*parts, *[F.lit(0)] * (3 - len(parts))]
    return F.struct(F.lit(number).alias("list"), *[p.cast("bigint").alias(n) for n, p in zip("abc", three)])


def keyword_queries(terms: DataFrame) -> DataFrame:
    """Terms flagged as queries; Thai before English within a category."""
    lang_ord = F.when(F.col("language") == "th", 0).otherwise(1)
    place = _place(0, F.col("cat_ord"), lang_ord, F.col("term_ord"))
    return terms.where("query").select(
        F.col("term").alias("q"), "category_id", "language", place.alias("ord")
    )


def competitor_queries(competitors: DataFrame, qualifiers: DataFrame, category: str) -> DataFrame:
    """Every competitor with every qualifier of every language.

    ``competitors``: competitor, ord. ``qualifiers``: language, qualifier, ord; a handful of
    configured words, attached to the competitors as one list and unfolded there.
    """
    words = qualifiers.agg(
        F.array_sort(F.collect_list(F.struct(F.col("ord").alias("qord"), "language", "qualifier"))).alias("words")
    )
    pairs = with_scalars(competitors.select("competitor", "ord"), words).select("competitor", "ord", F.inline("words"))
    return pairs.select(
        F.concat(F.lit('"'), F.col("competitor"), F.lit('" '), F.col("qualifier")).alias("q"),
        F.lit(category).alias("category_id"),
        "language",
        _place(1, F.col("ord"), F.col("qord")).alias("ord"),
    )


def brand_queries(brands: DataFrame, templates: tuple[tuple[str, str], ...], category: str) -> DataFrame:
    """Priority brands in every template. ``brands``: brand, priority, ord."""
    texts = []
    for i, (lang, template) in enumerate(templates):
        before, _, after = template.partition("{brand}")
        q = F.concat(F.lit(before), F.col("brand"), F.lit(after))
        texts.append(F.struct(q.alias("q"), F.lit(lang).alias("language"), F.lit(i).alias("t")))
    rows = brands.where("priority").select("ord", F.inline(F.array(*texts)))
    return rows.select(
        "q", F.lit(category).alias("category_id"), "language",
        _place(2, F.col("ord"), F.col("t")).alias("ord"),
    )


def distinct_queries(*parts: DataFrame) -> DataFrame:
    """Union of the lists; the first of equal queries per language wins."""
    union = reduce(lambda x, y: x.unionByName(y), parts)
    return first_by(union, [F.col("language"), F.lower("q")], F.col("ord"))


def all_queries(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """All stored queries of a lexicon."""
    words = [
        (lang, q, li * 100 + qi)
        for li, (lang, quals) in enumerate(lexicon.competitor_qualifiers)
        for qi, q in enumerate(quals)
    ]
    return distinct_queries(
        keyword_queries(lexicon.terms_df(spark)),
        competitor_queries(
            lexicon.competitors_df(spark),
            spark.createDataFrame(words, "language string, qualifier string, ord int"),
            lexicon.competitor_category,
        ),
        brand_queries(lexicon.brands_df(spark), lexicon.brand_templates, lexicon.brand_category),
    )


def queries_per_locale(queries: DataFrame, locales: DataFrame, n: int | None = None) -> DataFrame:
    """Queries of each locale's language, with ``n`` the first ones (D8); locales other than Thai take the English ones."""
    from briefloom.operators.ranking import first_per_source

    wanted = locales.withColumn("qlang", F.when(F.col("language") == "th", "th").otherwise("en")).drop("language")
    joined = queries.join(wanted, F.col("language") == F.col("qlang")).drop("qlang")
    return joined if n is None else first_per_source(joined, ["locale_id"], n)


# ---- term table against document table ----

_WORD = "[a-z0-9]+"
_BREAK = "[\\t\\n\\x0B\\f\\r]"
# Both patterns look ahead first: what is a letter, a digit or a blank is passed over by one small class.
#: Other characters from the first that is no white space.
_WIDE = "(?![a-z0-9 \\t\\n\\x0B\\f\\r])[^a-z0-9]++"
#: A single character that edges show as a space, other than the space.
_EDGE = "(?![a-z0-9 ])(?s:.)"
#: A word and its right neighbour, verbatim with all that stands between; found at the start of every word.
_NEIGHBOURS = "(?<![a-z0-9])(?=([a-z0-9]+[^a-z0-9]+[a-z0-9]+))"


def _tagged(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(f"{kind}:"), t))


def _postings(hay: Column) -> Column:
    """All probes of a text: words, neighbouring words, and runs of one to three other characters."""
    wide = F.regexp_extract_all(hay, F.lit(_WIDE), F.lit(0))
    grams = F.flatten(
        F.transform(
            wide,
            lambda run: F.flatten(
                F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.array(*[run.substr(i, F.lit(n)) for n in (1, 2, 3)]))
            ),
        )
    )
    words, neighbours = (F.regexp_extract_all(hay, F.lit(p), F.lit(g)) for p, g in ((_WORD, 0), (_NEIGHBOURS, 1)))
    breaks = F.regexp_extract_all(hay, F.lit(_BREAK), F.lit(0))
    return F.array_distinct(F.concat(_tagged("w", words), _tagged("n", neighbours), _tagged("c", grams), _tagged("c", breaks)))


def _choices(terms: DataFrame, term: str) -> DataFrame:
    """Every probe a term can be looked up by: (term, needle, latin, probe, whole).

    A phrase has its neighbouring words, a single word itself, any other term its first other characters. ``whole``: the
    probe is the term itself, so that a document with this posting holds it.
    """
    words = F.regexp_extract_all("needle", F.lit(_WORD), F.lit(0))
    neighbours = F.regexp_extract_all("needle", F.lit(_NEIGHBOURS), F.lit(1))
    symbol = F.regexp_extract("needle", "[^a-z0-9\\s][^a-z0-9]{0,2}", 0)
    symbols = F.concat(F.lit("c:"), F.when(symbol != "", symbol).otherwise(F.regexp_extract("needle", _BREAK, 0)))
    probes = (
        F.when(F.col("latin") & (F.size(neighbours) > 0), _tagged("n", neighbours))
        .when(F.col("latin") & (F.size(words) > 0), _tagged("w", words))
        .otherwise(F.array(symbols))
    )
    chosen = terms.select(term, "needle", "latin", F.explode(F.array_distinct(probes)).alias("probe"))
    return chosen.withColumn("whole", F.col("latin") & (F.substring("probe", 3, 1 << 30) == F.col("needle")) & ~F.col("probe").startswith("c:"))


def match_terms(docs: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term") -> DataFrame:
    """(key, term) for every term of a table that occurs in a document, same rules as ``contains_term``.

    The index holds the words of each document and its pairs of neighbouring words with what stands between them, as far
    as terms ask for them. A phrase is looked up by its rarest pair, a single word by itself, other terms by their first
    other characters. Where the probe is the whole term, the posting decides; the others found for a document are gathered
    and checked at word edges in one pass over its text. Documents and probes meet with a salt: a probe that very many
    documents hold is spread over tasks. No term is compared with every document. ``key`` must be unique.
    """
    needle = F.lower(F.trim(F.col(term)))
    prepared = terms.select(F.col(term), needle.alias("needle")).where(F.col("needle") != "").distinct()
    prepared = prepared.withColumn("latin", F.col("needle").rlike("^[ -~]+$"))
    choices = materialize(_choices(prepared, term), "choices")
    hay = docs.select(F.col(key), F.lower(F.col(text)).alias("hay"))
    # The wanted probes are written first: with their size known, a small set reaches the documents without a shuffle.
    wanted = materialize(choices.select("probe").distinct(), "wanted")
    found = materialize(hay.select(key, F.explode(_postings(F.col("hay"))).alias("probe")).join(wanted, "probe", "left_semi"), "probes")
    frequency = found.groupBy("probe").agg(F.count(F.lit(1)).alias("df"))
    # A probe that no document holds rules its term out; else the rarest one is looked up.
    rated = choices.join(frequency, "probe", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = rated.groupBy(term, "needle", "latin").agg(F.min(F.struct("df", "probe", "whole")).alias("p")).where("p.df > 0")
    lists = rarest.groupBy(F.col("p.probe").alias("probe")).agg(
        F.collect_list(F.struct(term, "needle", "latin", F.col("p.whole").alias("whole"))).alias("terms")
    )  # terms with one rarest probe
    candidates = materialize(salted_lookup(found, "probe", lists, key).select(key, F.explode("terms").alias("t")), "candidates")
    sure = candidates.where("t.whole").select(key, F.col(f"t.{term}").alias(term))
    per_doc = candidates.where("not t.whole").groupBy(key).agg(F.collect_set("t").alias("ts"))  # at most the terms that share a probe with the document
    padded = F.concat(F.lit(" "), F.regexp_replace("hay", _EDGE, " "), F.lit(" "))
    checked = (
        hay.join(per_doc, key)
        .withColumn("edges", padded)  # once per document, before its terms are unfolded
        .select(key, "hay", "edges", F.explode("ts").alias("t"))
        .where(_occurs(F.col("hay"), F.col("edges"), F.col("t.needle"), F.col("t.latin")))
        .select(key, F.col(f"t.{term}").alias(term))
    )
    return sure.unionByName(checked)


def _occurs(hay: Column, edges: Column, needle: Column, latin: Column) -> Column:
    """Whether a needle is in a text; a Latin one only between other characters than a-z and 0-9.

    ``edges`` is the text with a space for every such other character, and one around it. The needle in the same form
    has to be in it first; only then the exact place is looked for.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(needle, "[^a-z0-9]", " "), F.lit(" "))
    exact = F.regexp_like(hay, F.concat(F.lit("(^|[^a-z0-9])\\Q"), needle, F.lit("\\E([^a-z0-9]|$)")))
    return F.contains(hay, needle) & F.when(~latin, F.lit(True)).otherwise(F.when(F.contains(edges, plain), exact).otherwise(F.lit(False)))
