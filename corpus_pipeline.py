"""A training corpus from raw documents: quality, exact copies, near copies, benchmark passages, tokens.

Every stage takes the documents that its predecessor kept and returns documents with all their columns; the last one
returns tokens. ``run`` writes and rereads the table after each stage, so that a lost executor repeats one stage, and
deletes the table of a stage once the next one is written.

All stages keep extra columns, whatever their names, and give an empty table for an empty one. Null texts count as empty
ones; rows with a null identifier take part, and rank behind all others where one document of several stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.bpe import encode_decode
from briefloom.llm.decontam import drop_contaminated
from briefloom.llm.exact_dedup import drop_exact_copies
from briefloom.llm.jaccard_join import keep_one_per_class
from briefloom.llm.quality import keep_good
from briefloom.llm.queries import vocabulary
from briefloom.session import delete_folder, new_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and the labels, does not reject. Equal texts go together."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier. Of rows repeated as a whole, one."""
    return drop_exact_copies(docs, retain="largest")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest identifier. Texts without words stay."""
    return keep_one_per_class(docs, threshold=0.8, n_words=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words of a benchmark item, and no whole shorter item. Texts without words stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left, with digests of them and of the decoded text."""
    coded = encode_decode(docs, vocabulary("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if former is not None:
            delete_folder(spark, former)
        former = path
    return docs
