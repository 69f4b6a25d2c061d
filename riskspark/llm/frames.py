"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import ensure_checkpoint_dir

#: Stands for a null document id inside an operator, so that joins and sorts see it as one smallest id.
NULL_ID = -(1 << 63)


#: Bytes of rows that Spark hands a Python worker at once, and that a Parquet writer holds back.
BATCH_BYTES, ROW_GROUP_BYTES = 2 << 20, 16 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Within the block, jobs that are planned hand Python at most ``BATCH_BYTES`` at once; then the setting is as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for the session: rows hold whole texts, so a bound in rows bounds no memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project to the columns an operator needs, under its own names: other columns can't clash."""
    return df.select(*[quoted(old).alias(new) for new, old in columns.items()])


def id_key(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def id_back(col: Column) -> Column:
    return F.when(col != F.lit(NULL_ID), col)


def range_count(rows: DataFrame, text_col: str, bytes_each: int) -> int:
    """Hash ranges so that each answers for about ``bytes_each`` bytes of text at most, whatever the input; at least as
    many as the session has shuffle partitions."""
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, -(-int(total) // bytes_each))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: later reads neither recompute nor depend on executors."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with small_batches(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batch(schema: str, rows: list[tuple]):
    """An Arrow batch of rows under a schema text such as ``id long, parts array<binary>`` (within tasks)."""
    import pyarrow as pa
    plain = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
             "binary": pa.binary()}
    names, kinds = zip(*(column.split() for column in schema.split(", ")), strict=True)
    kinds = [pa.list_(plain[k[6:-1]]) if k.startswith("array<") else plain[k] for k in kinds]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
