"""At-risk scoring of arriving rows (K17 + B13 on a streaming DataFrame).

The reference reads one file once and has no streaming; this module only
re-aims the batch scoring operator: a fitted MLlib bundle is a chain of
narrow transforms, so it applies unchanged to ``readStream`` input. Rows are
scored as they arrive, filtered at the threshold and appended to a sink with
a checkpoint location (exactly-once file sink, restartable after failure).
kNN bundles need a join against their training rows plus a count, so they
are batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.columns import DEFAULT_AT_RISK_THRESHOLD, pct_1dp, risk_level


def score_stream(stream: DataFrame, bundle, id_col: str, threshold: float = DEFAULT_AT_RISK_THRESHOLD
                 ) -> DataFrame:
    """Streaming DataFrame of at-risk rows: input columns + p, p_pct, risk_level."""
    if bundle.kind != "mllib":
        raise TypeError("only MLlib bundles score streams")
    scored = bundle.score(stream, id_col)
    return (scored.where(F.col("p") >= F.lit(float(threshold)))
                  .withColumn("p_pct", pct_1dp("p"))
                  .withColumn("risk_level", risk_level("p")))


def start_at_risk_sink(spark: SparkSession, source_dir: str, schema, bundle, id_col: str, sink_dir: str,
                       checkpoint_dir: str, threshold: float = DEFAULT_AT_RISK_THRESHOLD, fmt: str = "parquet",
                       available_now: bool = False):
    """readStream(source_dir) -> score -> at-risk filter -> append to sink_dir; returns the query."""
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    out = score_stream(src, bundle, id_col, threshold)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
