"""Feature preparation.

* ``label_encode`` - ordered codes (sorted values from 0) via ``StringIndexer``
* ``PopulationScaler`` - (x - mean) / population std, std 0 -> 1, as an
  MLlib ``Estimator``/``Model`` pair so it saves inside a ``PipelineModel``
  (MLlib's ``StandardScaler`` uses the sample std and maps std 0 to 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_TYPES = ("string", "varchar", "char", "date", "timestamp")
NUMERIC_TYPES = ("int", "bigint", "double", "float", "smallint", "tinyint")


def feature_frame(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    """B1: drop id/label columns if present."""
    return df.drop(*[c for c in drop if c in df.columns])


def split_columns_by_type(df: DataFrame, id_col: str | None = None, label: str | None = None
                          ) -> tuple[list[str], list[str]]:
    """B2: (categorical columns, numeric columns), without id and label.

    Strings, dates and timestamps are categorical (a date in a CSV is text and gets a code per value); numbers and
    booleans (0/1) are numeric. Other types (arrays, maps, structs, binary) raise: no column is left out silently.
    """
    cats, nums = [], []
    for name, kind in df.dtypes:
        if name in (id_col, label):
            continue
        if kind.startswith(TEXT_TYPES):
            cats.append(name)
        elif kind in NUMERIC_TYPES or kind == "boolean" or kind.startswith("decimal"):
            nums.append(name)
        else:
            raise TypeError(f"column {name!r} of type {kind} is no feature: drop or convert it")
    return cats, nums


def encodable(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Dates and timestamps among the categorical columns as text, as the encoder takes them."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("string") for c in cats if c in kinds and kinds[c] != "string"})


def align_features(df: DataFrame, cols: Sequence[str], fill=0, keep: Sequence[str] = ()) -> DataFrame:
    """Training column order; missing columns filled with ``fill``; extras dropped."""
    present = set(df.columns)
    return df.select(*[F.col(c) for c in keep if c in present],
                     *[F.col(c) if c in present else F.lit(fill).alias(c) for c in cols])


def complete_row(cols: Sequence[str]) -> Column:
    """True where every listed number column has a value (neither null nor NaN)."""
    out = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        out = out & x.isNotNull() & ~F.isnan(x)
    return out


def label_encoder(cols: Sequence[str], suffix: str = "__code", handle_invalid: str = "error") -> StringIndexer:
    """K1: one multi-column ``StringIndexer`` (a single pass over the data for all columns).

    Codes are assigned by sorted value from 0 (``alphabetAsc``); unseen values
    and nulls raise by default, as in the reference.
    """
    cols = list(cols)
    return StringIndexer(inputCols=cols, outputCols=[f"{c}{suffix}" for c in cols], stringOrderType="alphabetAsc",
                         handleInvalid=handle_invalid)


class CodeReplacer(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Moves ``<c>__code`` columns back onto ``<c>`` as plain doubles (ordinal, no nominal metadata)."""

    cols = Param(Params._dummy(), "cols", "encoded columns", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, cols=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.cols)
        out = df
        for c in cols:
            out = out.withColumn(c, F.col(f"{c}__code").cast("double")).drop(f"{c}__code")
        return out


def fit_label_encoder(df: DataFrame, cols: Sequence[str], handle_invalid: str = "error") -> PipelineModel:
    """K1 fit: returns a PipelineModel that replaces each column by its code (double)."""
    cols = list(cols)
    stages = [label_encoder(cols, handle_invalid=handle_invalid).fit(df)] if cols else []
    return PipelineModel(stages=stages + [CodeReplacer(cols=cols)])


def encoder_labels(model: PipelineModel) -> dict:
    """Column -> sorted category list of a fitted K1 encoder."""
    out = {}
    for st in model.stages:
        if isinstance(st, StringIndexerModel):
            ins = st.getInputCols() if st.isSet(st.inputCols) else [st.getInputCol()]
            labs = st.labelsArray
            out.update({c: list(v) for c, v in zip(ins, labs)})
    return out


def decode_labels(model: PipelineModel, df: DataFrame, col: str) -> DataFrame:
    """K1 inverse: code -> value for one encoded column."""
    labels = encoder_labels(model)
    if col not in labels:
        raise KeyError(col)
    return IndexToString(inputCol=col, outputCol=f"{col}__value", labels=labels[col]).transform(
        df.withColumn(col, F.col(col).cast("double")))


class _ScalerParams(HasInputCols):
    means = Param(Params._dummy(), "means", "column means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population stds (0 replaced by 1)",
                 typeConverter=TypeConverters.toListFloat)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """K2 fit: one distributed aggregate (avg, stddev_pop) over the input columns."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        aggs = []
        for c in cols:
            aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                     F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        means = [float(row[f"m_{c}"] or 0.0) for c in cols]
        stds = [float(row[f"s_{c}"] or 0.0) for c in cols]
        stds = [1.0 if s == 0.0 else s for s in stds]
        return PopulationScalerModel(inputCols=list(cols), means=means, stds=stds)


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """K2 transform: in place (x - mean) / std for each input column (narrow, codegen)."""

    @keyword_only
    def __init__(self, inputCols=None, means=None, stds=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        means, stds = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                               for c, m, s in zip(cols, means, stds) if c in df.columns})

    def table(self, spark) -> DataFrame:
        cols = self.getInputCols()
        return spark.createDataFrame(list(zip(cols, self.getOrDefault(self.means), self.getOrDefault(self.stds))),
                                     "feature string, mean double, std double")
