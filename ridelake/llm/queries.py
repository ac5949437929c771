"""The registered queries of the training-text operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.llm import (
    audit, chat, decontam, langid, lines, merkle, packing, quality, simhash, substrings, topk, toxicity, warc,
)
from ridelake.llm.samples import fold
from ridelake.llm.sql import AUDIT_SQL, CHAT_SQL, MERKLE_SQL, QUALITY_SQL, TOP_K_SQL
from ridelake.plans.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], turns.schema)
    examples = chat.prefix_examples(chat.format_conversations(turns.unionByName(probe)))
    return chat.conversation_digests(examples)


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.learn(docs, labels), threshold=0.3)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.where(fold("doc_id", 5) != 0))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_chunks(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_removed", F.size("removed").cast("long").alias("n_chunks"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op8_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, max_distance=4)


def op9_prefix_free_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), min_payload=0)
    records = warc.read_archives(manifest)
    sound = F.assert_true("digest_ok", F.concat(F.lit("digest mismatch in "), "path"))
    return records.where(sound.isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    # An id that is null has no checksum and is not tampered with.
    raised = merkle.row_digest(*[
        F.col(f).cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f) for f in fields
    ])
    claimed = F.when(fold("doc_id", 7) == 0, raised).otherwise(merkle.row_digest(*[F.col(f) for f in fields]))
    return merkle.manifest(table(spark, sf_dir, "documents"), fields, claimed=claimed).proofs()


def op13_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_chat_prefix_targets, op2_toxicity_grammar, op3_host_quality, op4_language_spans,
        op5_template_decontamination, op6_line_chunks, op7_sum_of_squares_packing, op8_simhash_multi_index,
        op9_prefix_free_substrings, op10_warc_round_trip, op11_filter_interactions, op12_merkle_manifest,
        op13_norm_bucketed_top_k,
    )
}
SQL: dict[str, str] = {
    "op1_chat_prefix_targets": CHAT_SQL, "op3_host_quality": QUALITY_SQL, "op11_filter_interactions": AUDIT_SQL,
    "op12_merkle_manifest": MERKLE_SQL, "op13_norm_bucketed_top_k": TOP_K_SQL,
}
