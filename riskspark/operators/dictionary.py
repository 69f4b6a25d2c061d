"""Ordered dictionaries of any size (K1, C3): value -> code and back by joins.

The distinct values are dealt over range partitions, written once, and numbered
partition by partition with running offsets; nothing passes through one task
or the driver, so a key with as many values as rows can be encoded.
``DictionaryEncoder`` is the form that saves inside a pipeline: its state is a
Parquet table, and it encodes by joins, which the planner broadcasts where the
table's size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import cut_lineage, written


def fit_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, code): distinct non-null values numbered from 0 in ascending order."""
    values = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    dealt = cut_lineage(values.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_off"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("value"))
    return cut_lineage(dealt.join(offsets, "_part").select("value", (F.col("_off") + place - 1).cast("long").alias("code")))


def encode_lookup(df: DataFrame, dictionary: DataFrame, col: str, unseen: str = "error", out: str | None = None
                  ) -> DataFrame:
    """Add the code of ``col``. Null has no code. ``unseen`` values raise ('error') or have no code ('null')."""
    if unseen not in ("error", "null"):
        raise ValueError("unseen must be 'error' or 'null'")
    out = out or f"{col}_code"
    coded = df.join(dictionary.select(F.col("value").alias(col), F.col("code").alias(out)), col, "left")
    if unseen == "error":
        known = F.col(out).isNotNull() | F.col(col).isNull()
        message = F.concat(F.lit(f"value of {col} not in the dictionary: "), F.col(col).cast("string"))
        coded = coded.withColumn(out, F.when(known, F.col(out)).otherwise(F.raise_error(message).cast("long")))
    return coded


def decode_lookup(df: DataFrame, dictionary: DataFrame, code_col: str, out: str) -> DataFrame:
    """Add the value of a code; a code without a value gives null."""
    return df.join(dictionary.select(F.col("code").alias(code_col), F.col("value").alias(out)), code_col, "left")


DICTIONARY = "column string, value string, code long"


def fit_dictionaries(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): the non-null values of several columns as text, each column numbered from 0 in order.

    One pass over the rows; values are combined before they are shuffled. Written to the shared folder.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    values = df.select(cells.alias("c")).select("c.*").where(F.col("value").isNotNull()).distinct()
    return number_values(values)


def number_values(values: DataFrame) -> DataFrame:
    """(column, value, code): distinct (column, value) rows numbered from 0 in each column's order; written once."""
    dealt = written(values.repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id()), "values")
    earlier = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "column", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("column", "_part").orderBy("value"))
    return written(dealt.join(offsets, ["column", "_part"]).select(
        "column", "value", (F.col("_off") + place - 1).cast("long").alias("code")), "dictionary")


class _EncoderParams(Params):
    cols = Param(Params._dummy(), "cols", "columns to encode", typeConverter=TypeConverters.toListString)
    unseen = Param(Params._dummy(), "unseen", "'error': a value that was not fitted ends the job; 'null': it has no code",
                   typeConverter=TypeConverters.toString)


class DictionaryEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """K1 as a pipeline stage for columns of any number of values: codes by sorted value from 0, as doubles in place.

    Nulls have no code (null). Unlike ``StringIndexer`` no list of values passes through a task or the driver.
    """

    @keyword_only
    def __init__(self, cols=None, unseen="error"):
        super().__init__()
        self._setDefault(unseen="error")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> DictionaryEncoderModel:
        cols = self.getOrDefault(self.cols)
        return DictionaryEncoderModel(cols=cols, unseen=self.getOrDefault(self.unseen)).holding(
            fit_dictionaries(df, cols) if cols else df.sparkSession.createDataFrame([], DICTIONARY))


class DictionaryEncoderModel(Model, _EncoderParams, MLReadable, MLWritable):
    """Fitted form; ``dictionary`` is its table (column, value, code), which ``save`` writes beside the parameters."""

    dictionary: DataFrame

    @keyword_only
    def __init__(self, cols=None, unseen="error"):
        super().__init__()
        self._setDefault(unseen="error")
        self._set(**self._input_kwargs)

    def holding(self, dictionary: DataFrame) -> DictionaryEncoderModel:
        self.dictionary = dictionary
        return self

    def copy(self, extra=None) -> DictionaryEncoderModel:
        return super().copy(extra).holding(self.dictionary)

    def of(self, col: str) -> DataFrame:
        """(value, code) of one column."""
        return self.dictionary.where(F.col("column") == F.lit(col)).select("value", "code")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.getOrDefault(self.cols):
            if c in df.columns:
                out = encode_lookup(out.withColumn(c, F.col(c).cast("string")), self.of(c), c,
                                    self.getOrDefault(self.unseen), "_code").withColumn(
                                        c, F.col("_code").cast("double")).drop("_code")
        return out.select(*df.columns)

    def write(self) -> MLWriter:
        return _DictionaryWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DictionaryReader()


class _DictionaryWriter(MLWriter):
    def __init__(self, model: DictionaryEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.dictionary.write.parquet(f"{path}/dictionary")


class _DictionaryReader(MLReader):
    def load(self, path: str) -> DictionaryEncoderModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DictionaryEncoderModel()
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model.holding(self.sparkSession.read.schema(DICTIONARY).parquet(f"{path}/dictionary"))
