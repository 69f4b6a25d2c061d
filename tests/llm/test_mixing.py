import re

import pytest
from pyspark.sql import functions as F

from riskspark.llm import mixing as M
from riskspark.llm.queries import table

SF = "/root/testdata/sf0.001"


def brute_seats(votes, n):
    seats = {k: 0 for k in votes}
    for _ in range(n):
        best = max((v / (2 * seats[k] + 1), -k) for k, v in votes.items())
        seats[-best[1]] += 1
    return seats


@pytest.mark.parametrize("votes,n", [({1: 53.0, 2: 24.0, 3: 23.0}, 7), ({1: 1.0, 2: 1.0, 3: 1.0, 4: 97.0}, 10),
                                     ({1: 6.0, 2: 0.0, 3: 2.0}, 5), ({k: float(k * k % 17 + 1) for k in range(1, 30)}, 101)])
def test_highest_quotients(spark, votes, n):
    df = spark.createDataFrame(list(votes.items()), "src long, v double")
    got = {r["src"]: r["quota"] for r in M.apportion(df, "v", F.lit(n), [], ["src"]).collect()}
    assert got == brute_seats(votes, n)


def test_targets(spark):
    sizes = {"a": 100, "b": 10, None: 5, "c": 1000, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
    names = ["a", "b", "c", "d", None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap, total, want, free = {s: 3 * sizes[s] for s in names}, sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(want.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap[s]]
        if not over:
            break
        for s in over:
            want[s] = cap[s]
            free.discard(s)
    want |= share
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    docs = table(spark, SF, "documents")
    got = M.mixed_rows(docs).collect()
    again = M.mixed_rows(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    for taken, size, target, source_size in by.values():
        assert size == source_size
        assert abs(taken - target) <= 0.02 * target + 3 * M.BLOCK_WORDS
    assert sum(s[2] for s in by.values()) == pytest.approx(sum(s[1] for s in by.values()))


def test_mixture_holds_the_taken_words(spark):
    docs = table(spark, SF, "documents")
    taken = sum(r["taken"] for r in M.mixed_rows(docs).collect())
    out = M.mixture(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(M.n_words(F.col("text")))).first()[0] == taken


def test_edge_rows(edges, nothing, all_null, edge_texts):
    got = M.mixed_rows(edges, shard_words=500).collect()
    assert len(got) == len(edge_texts)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert M.mixture(edges).columns == edges.columns
    assert M.mixed_rows(nothing).count() == 0 and M.mixture(nothing).count() == 0
    assert {(r["size"], r["taken"]) for r in M.mixed_rows(all_null).collect()} == {(0, 0)}
