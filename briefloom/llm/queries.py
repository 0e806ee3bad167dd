"""The registered queries of this folder, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.chat import format_chats

    chats = format_chats(_table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "n_turns", "n_copies", F.sha2("rendered", 256).alias("rendered_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.bpe import encode_decode

    coded = encode_decode(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _listed(spans: str) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    one = F.transform(F.expr(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.array_join(one, ",")


def _span_report(found: DataFrame, kinds: tuple[str, ...], *more: Column) -> DataFrame:
    counts = [F.size(F.expr(f"filter(spans, x -> x.base and x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in kinds]
    digest = F.sha2(_listed("filter(spans, x -> x.base)"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), _listed("spans").alias("spans"), *more)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.pii import BASE_KINDS, find_pii

    found = find_pii(_table(spark, sf_dir, "documents"))
    scores = F.array_join(F.transform("spans", lambda x: F.format_string("%.2f", x["score"])), ",")
    return _span_report(found, BASE_KINDS, scores.alias("scores"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.secrets import BASE_KINDS, find_secrets

    return _span_report(find_secrets(_table(spark, sf_dir, "documents")), BASE_KINDS)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.decontam import find_contamination

    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.jaccard_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"), threshold=0.8, n_words=5)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"), retain="largest")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.spelling import run_counts, variant_groups

    words = run_counts(_table(spark, sf_dir, "documents"), min_length=6, min_count=5, typo_every=199)
    return variant_groups(words, ratio=5)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from briefloom.llm.lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_bpe_encode_decode": op3_bpe_encode_decode,
    "op4_pii": op4_pii,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_packing": op11_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op1_chat_formatting": """
        WITH turns AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                   '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS part
            FROM turns
        ), prefixes AS (
            SELECT conv_id, pos, string_agg(part, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
                   count(*) OVER (PARTITION BY conv_id) AS n_turns
            FROM placed
        ), whole AS (
            SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, prefix AS rendered
            FROM prefixes WHERE pos = n_turns GROUP BY n_turns, prefix
        )
        SELECT conv_id, n_turns, n_copies, sha256(rendered) AS rendered_sha256
        FROM whole
        WHERE rendered NOT IN (SELECT prefix FROM prefixes WHERE pos < n_turns)
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
        ), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL
        ), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
        ), weight AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total
        ), impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
            FROM postings JOIN sizes USING (doc_id) JOIN weight USING (term), total
        ), wanted AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), scored AS (
            SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}
