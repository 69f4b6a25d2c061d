"""Registered queries of the training-data operators: production parameters, whole tables, contract columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import (
    chunk_dedup,
    conversation_repair,
    decontaminate,
    exact_dedup,
    language,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    pitman_yor,
    secret_scan,
    toxicity,
    wavelet,
)

#: Id appended to every document of the token output.
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_wavelet_tokens(spark, sf_dir):
    found = wavelet.tokenise(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mixed_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op5_chunk_dedup(spark, sf_dir):
    found = chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chunks", "n_repeated", "repeated_words", "longest_run_words", "dropped_words",
                        (F.col("repeated_words") > 0).alias("repeated"), "keep_ids", "dropped_spans", "inner_words",
                        "inner_spans")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.toxic_labels(table(spark, sf_dir, "labels")))
    return toxicity.severity(docs, model)


def op7_exact_dedup(spark, sf_dir):
    # three quarters of the ids stand for the snapshot, the rest for the incoming batch
    old = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0
    return exact_dedup.groups(table(spark, sf_dir, "documents"), old)


def op8_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "kept")


def op10_secrets(spark, sf_dir):
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op11_pitman_yor(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return pitman_yor.scores(table(spark, sf_dir, "documents"), held_out)


def op12_conversation_repair(spark, sf_dir):
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, present_col="present")


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(docs, tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


REGISTRY = {f.__name__: f for f in (
    op1_wavelet_tokens, op2_decontaminate, op3_language, op4_mixing, op5_chunk_dedup, op6_toxicity, op7_exact_dedup,
    op8_line_dedup, op9_near_dedup, op10_secrets, op11_pitman_yor, op12_conversation_repair, op13_merkle)}
