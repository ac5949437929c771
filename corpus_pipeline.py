"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``ridelake.llm``.

Every stage but the last returns the columns of ``documents`` and works on all that its predecessor kept; between stages the
rows are written as Parquet and read again, so no stage repeats the work of another and lost executors cost one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.llm import decontam, langid, lines, packing, simhash
from ridelake.plans.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # trained scores, fingerprints and token ids are beyond SQL; see tests/llm/test_pipeline.py


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; those without letters (or without an id, which later stages need) go."""
    predicted = langid.identify(docs, docs)
    known = predicted.where((F.col("lang_pred") != langid.UNKNOWN) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(known, "doc_id", "left_semi").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier one has; those of which nothing but blanks is left go."""
    kept = lines.remove_chunks(docs, carry=("lang", "source"))
    left = kept.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    return left.select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars")
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near-duplicates, the one with the smallest id; of rows alike in id and text one."""
    groups = simhash.near_duplicates(docs, width=4, max_distance=4)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").withColumn("body", F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", "body"]).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hits = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
