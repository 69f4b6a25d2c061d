"""Corpus pipeline: five stages from raw documents to token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
every stage's rows as Parquet to the cluster's shared folder and reads them
back as the next stage's documents, so a lost executor never costs more than
the stage in progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import decontaminate, mixing, near_dedup, toxicity, wavelet
from riskspark.llm.frames import quoted, stored
from riskspark.llm.queries import END_ID, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; it learns from the labels of this stage's documents."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, toxicity.toxic_labels(table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Equal rows share their fate."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                       F.xxhash64("doc_id", "text").alias("key"))
    found = decontaminate.contamination(rows.select("key", F.col("row.text").alias("text")),
                                        table(spark, sf_dir, "benchmark"), id_col="key")
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return rows.join(bad, "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's share of the mix takes it."""
    return mixing.mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in document order; returns the document index read back from them."""
    return wavelet.tokenise(docs, tokenizer_path(), END_ID).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL can't express the fitted model, the sampled buckets and the tokenizer: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
