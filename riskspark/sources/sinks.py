"""Sinks (A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_at_risk(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chosen columns to CSV with a header and no index; one file per task (no single-task write)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_at_risk(spark, path: str, schema=None) -> DataFrame:
    """Read an exported list back (explicit schema preferred; inferred otherwise)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)
