"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed with the ``noop`` sink (full computation, nothing
collected); light queries report the median of 3 warm runs, heavy ones
(model training, flagship report) a single warm run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskspark.plans import catalog as K  # noqa: E402
from riskspark.session import build_session  # noqa: E402

LIGHT = ["rate_by_segment", "rate_by_scores", "rate_by_band", "class_histogram_amount", "describe_numeric",
         "roc_curve", "roc_auc", "classification_report", "stratified_split", "fold_assign", "smote_docs",
         "knn_join", "knn_classify", "row_contributions", "at_risk_list"]
HEAVY = ["at_risk_report", "train_and_compare"]


def run(spark, name, sf_dir):
    t0 = time.time()
    K.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    times = {}
    for name in LIGHT + HEAVY:
        if only and name not in only:
            continue
        runs = 1 if name in HEAVY else 3
        run(spark, name, sf_dir)  # warm-up
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
