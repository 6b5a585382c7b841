"""A training corpus from `documents`: quality, near-duplicates, repeated passages, benchmark items, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; `run` writes each result as
Parquet in the shared folder and reads it back as the next stage's input.
"""
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm import bpe, contamination, minhash, quality, suffixes
from tidemark.llm.folds import prefix_for, protected
from tidemark.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules accept; the columns of `docs`."""
    safe, back = protected(docs, [*quality.FEATURES, "votes", "p_good", "base_failed", "kept"])
    return back(quality.quality(safe).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near-duplicates (five words, 80 %); the columns of `docs`.

    Rows that repeat a doc_id and its text stay one row. Rows without doc_id take part under a key of their text that
    comes after all ids: one of each group of them stays, unless a row with an id stands for it.
    """
    key = f"{prefix_for(docs)}key"
    keyed = docs.withColumn(key, _key(docs))
    found = minhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), n=5, percent=80)
    kept = found.where("kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key, "text"]).select(*docs.columns)


def _key(docs: DataFrame) -> Column:
    """doc_id, and for a row without one a key of its text beyond the largest id."""
    text = F.coalesce("text", F.lit(""))
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\U0010ffff"), F.sha2(text, 256)))
    largest = docs.agg(F.max("doc_id")).first()[0] or 0
    room = max(1, (1 << 63) - 2 - max(0, largest))
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(largest).cast("bigint") + 1 + F.pmod(F.xxhash64(text), F.lit(room)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that stand elsewhere too; the columns of `docs`.

    Every place of a repeated passage goes, as in the operator; a document without words after that goes too.
    """
    return suffixes.without_repeats(docs).select(*docs.columns)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; the columns of `docs`."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document left."""
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids", "decoded")


def _bounded(stage):
    """The stage with Arrow batches of BATCH_ROWS rows, so that a Python worker holds few whole texts at a time."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    run_stage.__doc__, run_stage.__name__ = stage.__doc__, stage.__name__
    return run_stage


BATCH_ROWS = 1_000
STAGES = [
    ("quality rules", _bounded(quality_rules)),
    ("near-duplicates", _bounded(near_duplicates)),
    ("repeated passages", _bounded(repeated_passages)),
    ("benchmark items", _bounded(benchmark_items)),
    ("tokens", _bounded(tokens)),
]
# Expectation-maximisation of the first stage is not SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs.withColumn("ids", F.sha2("ids", 256)).withColumn("decoded", F.sha2("decoded", 256)) \
        .withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
