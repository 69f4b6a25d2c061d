"""Stand-in labelled views over the driver tables, with DuckDB SQL twins.

The reference works on one HR table; the driver ships TPC-H-like tables, so
every operator takes its roles (id, label, groups, features) as parameters and
these views assign them:

* ``orders_view``    - orders x customer x nation x region (one row per order)
* ``documents_view`` - documents x labels (imbalanced ``toxic`` label)
* ``embeddings_view``- embeddings with a binary ``label = 0`` target

Reads name only the columns they use, so the parquet scans prune columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.columns import HASH_SCALE, id_hash52


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions; Spark's
    # size statistics broadcast them; customer vs orders is left to the
    # planner/AQE (sort-merge at scale, broadcast when the statistics say small).
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, c.c_nationkey == n.n_nationkey)
          .join(r, n.n_regionkey == r.r_regionkey))
    is_f = F.col("o_orderstatus") == F.lit("F")
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.when(is_f, F.lit(1)).otherwise(F.lit(0)).alias("label"),
        F.when(is_f, F.lit("Yes")).otherwise(F.lit("No")).alias("label_text"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("Yes"))
         .otherwise(F.lit("No")).alias("urgent"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority_score"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("balance"),
        (F.year("o_orderdate") - F.lit(1995)).cast("int").alias("tenure"),
        ((id_hash52("o_orderkey") % F.lit(1000)).cast("double") / F.lit(1000.0)).alias("fixed_score"),
    )


ORDERS_VIEW_SQL = """
v_ord AS (
  SELECT o.o_orderkey AS id,
         CAST(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS label,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS label_text,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Yes' ELSE 'No' END AS urgent,
         c.c_mktsegment AS segment,
         n.n_name AS nation,
         r.r_name AS region,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS priority_score,
         o.o_totalprice AS amount,
         c.c_acctbal AS balance,
         CAST(year(o.o_orderdate) - 1995 AS INTEGER) AS tenure,
         CAST(('0x' || substr(md5(CAST(o.o_orderkey AS VARCHAR)), 1, 13))::BIGINT % 1000 AS DOUBLE) / 1000.0
           AS fixed_score
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    # Whole texts: counts of separators (one byte each) over the full string.
    n_words = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit(""))) + F.lit(1)).cast("long")
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + F.lit(1)).cast("long")
    return j.select(
        F.col("doc_id").alias("id"),
        F.col("toxic").alias("label"),
        F.col("quality"),
        F.col("lang"),
        F.col("source"),
        F.col("n_chars"),
        n_words.alias("n_words"),
        n_lines.alias("n_lines"),
    )


DOCUMENTS_VIEW_SQL = """
v_doc AS (
  SELECT d.doc_id AS id,
         l.toxic AS label,
         l.quality AS quality,
         d.lang AS lang,
         d.source AS source,
         d.n_chars AS n_chars,
         CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS BIGINT) AS n_words,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS BIGINT) AS n_lines
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def embeddings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("klass"),
        F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0)).alias("label"),
    )


EMBEDDINGS_VIEW_SQL = """
v_emb AS (
  SELECT vec_id AS id,
         CAST(embedding AS DOUBLE[]) AS features,
         label AS klass,
         CAST(CASE WHEN label = 0 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM embeddings
)"""

__all__ = [
    "read", "orders_view", "documents_view", "embeddings_view",
    "ORDERS_VIEW_SQL", "DOCUMENTS_VIEW_SQL", "EMBEDDINGS_VIEW_SQL", "HASH_SCALE",
]
