import hashlib

import numpy as np
from pyspark.sql import functions as F

from riskspark.llm import exact_dedup as E


def test_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        f = E.FuseFilter.build(keys)
        assert f.contains(keys).all()
        other = rng.integers(2 ** 63, 2 ** 64 - 1, 100_000, dtype=np.uint64)
        assert f.contains(other).mean() < 1e-3


def check(rows, texts, ids, old):
    have = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"])
                  for r in E.groups(rows, old).collect())
    low = lambda i: -2 ** 63 if i is None else i
    want = []
    for i, t in zip(ids, texts, strict=True):
        group = [j for j, u in zip(ids, texts, strict=True) if (u or "") == (t or "")]
        top = max(group, key=low)
        want.append((str(i), str(top), len(group), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
    assert have == sorted(want)


def test_equals_brute_force(frame, edges, edge_texts, edge_ids):
    old = F.col("doc_id") % 2 == 0
    check(edges, edge_texts, edge_ids, old)
    check(edges, edge_texts, edge_ids, F.lit(True))
    check(edges, edge_texts, edge_ids, F.lit(None).cast("boolean"))
    texts = ["hot"] * 300 + [f"t{i % 40}" for i in range(100)]  # one group is most rows and is dealt out for the byte check
    check(frame(texts), texts, list(range(400)), old)


def test_differing_bytes_under_one_digest_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "a", False)], "id long, text string, old boolean")
    digest = hashlib.sha256(b"a").hexdigest()
    repeats = spark.createDataFrame([(digest, 2, 3)], "digest string, n long, top long")
    assert E._differing(rows, repeats).count() == 0
    forged = spark.createDataFrame([(hashlib.sha256(b"b").hexdigest(), 2, 2)], "digest string, n long, top long")
    assert E._differing(rows, forged).count() == 0


def test_empty_tables(nothing, all_null):
    assert E.groups(nothing, F.lit(True)).count() == 0
    got = E.groups(all_null, F.col("doc_id") > 0).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(None, None, 3, True)}
