import math
import random

import numpy as np

from riskspark.llm import toxicity as T

BAD = ["vok", "krult", "zemp", "drash"]


def corpus(seed, n, near=0):
    from .conftest import prose
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 80)).split()
        bad = i % 6 == 0
        for _ in range(rng.randint(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def labels_of(spark, toxic):
    return spark.createDataFrame([*enumerate(toxic), (None, 1), (3, None), (10 ** 6, 1)], "doc_id long, toxic int")


def test_planted_rows_are_rejected_and_clean_ones_kept(spark, frame):
    texts, toxic = corpus(1, 900)
    docs = frame(texts)
    model = T.fit(docs, T.toxic_labels(labels_of(spark, toxic[:600])))
    got = {r["doc_id"]: r for r in T.severity(docs, model).collect()}
    assert np.mean([got[i]["rejected"] for i in range(600, 900) if toxic[i]]) > 0.95
    assert not any(got[i]["rejected"] for i in range(900) if not toxic[i])
    assert (np.diff(model.thresholds) > 0).all()
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["rejected"]}
    more = T.severity(frame(["ba de " + " ".join(BAD), "ba de vok", "ba de"]), model).orderBy("doc_id").collect()
    assert more[0]["expected_severity"] > more[1]["expected_severity"] > more[2]["expected_severity"]


def test_thresholds_and_weights_are_a_maximum():
    """Moving any threshold or weight of the fitted model lowers the penalised likelihood."""
    rng = np.random.default_rng(4)
    words = [np.unique(rng.integers(1, 400, 30)).astype(np.uint64) for _ in range(400)]
    toxic = np.array([int(np.isin(w, [3, 5, 9]).any()) if rng.random() > 0.1 else 0 for w in words])
    model = T.fit_sample(toxic, words, ridge=0.5, steps=1500)
    assert len(model.features)
    grade = T._grade(toxic, words, model.features, np.isin(model.features, [3, 5, 9]))
    once = T._alike(words)

    def loss(weights, theta):
        m = T.OrdinalModel(model.features, weights, theta)
        x = m.score(np.array([len(w) for w in words]), np.concatenate(words))
        edge = np.concatenate([np.ones((len(x), 1)), m.above(x), np.zeros((len(x), 1))], axis=1)
        at = np.arange(len(x))
        return -(once * np.log(edge[at, grade] - edge[at, grade + 1])).sum() + 0.25 * (weights ** 2).sum()

    best = loss(model.weights, model.thresholds)
    for k in range(len(model.weights)):
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.thresholds) > best - 1e-6
    for k in range(len(model.thresholds)):
        for step in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(model.weights, moved) > best - 1e-6


def test_copies_count_once():
    texts = [np.arange(1000 * i, 1000 * i + 30).astype(np.uint64) for i in range(400)]
    weight = T._alike([texts[0], texts[0], *texts])
    assert weight.tolist() == [1 / 3] * 3 + [1] * 399


def test_texts_that_share_a_rare_marker_count_each():
    rng = np.random.default_rng(6)
    texts = [rng.choice(np.arange(1, 401), 10, replace=False).astype(np.uint64) for _ in range(2000)]
    toxic = np.array([int(i % 111 == 0) for i in range(2000)])
    words = [np.sort(np.append(t, np.uint64(9999))) if bad else np.sort(t) for t, bad in zip(texts, toxic, strict=True)]
    assert 10 < toxic.sum() < 20  # the marker is in less than 1 % of the texts
    assert (T._alike(words) == 1).all()
    model = T.fit_sample(toxic, words)
    assert 9999 in model.features.tolist()
    one = np.sort(np.append(np.arange(1, 8), 9999)).astype(np.uint64)
    assert model.above(model.score(np.array([8]), one))[0, 0] >= T.REJECT
    near = [np.sort(np.append(words[0], np.arange(5000, 5030))).astype(np.uint64)] * 2
    near[1] = np.sort(np.append(near[1][:-1], 6000)).astype(np.uint64)  # one word of 41 differs
    assert T._alike([*near, *words]).tolist() == [0.5] * 2 + [1] * 2000


def test_edge_rows(spark, edges, nothing, all_null, edge_texts):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(edges, T.toxic_labels(none))
    assert not any(r["rejected"] for r in T.severity(edges, model).collect())
    some = T.toxic_labels(spark.createDataFrame([(5, 1), (9, 0), (13, 0)], "doc_id long, toxic int"))
    assert T.severity(edges, T.fit(edges, some)).count() == len(edge_texts)
    assert T.severity(nothing, T.fit(nothing, some)).count() == 0
    assert T.keep_clean(nothing, model).count() == 0
    got = T.severity(all_null, T.fit(all_null, some)).collect()
    assert {(r["expected_severity"], r["rejected"]) for r in got} == {(0.0, False)}


def test_the_sample_bound_holds_for_rows(spark):
    rows = [(i % 50, f"word{i} text{i % 7}") for i in range(6000)] + [(3, "word3 text3")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    marks, words = T._sample(docs, T.toxic_labels(labels), "doc_id", "text", 100)
    assert len(marks) == len(words) == 100
    again, _ = T._sample(docs.repartition(7), T.toxic_labels(labels), "doc_id", "text", 100)
    assert (again == marks).all()


def test_scores_are_those_of_a_plain_loop(spark):
    from riskspark.llm.textbuf import words_of
    model = T.OrdinalModel(np.sort(np.concatenate([h for _, _, h in words_of(["bad worse evil"])])),
                           np.array([1.5, -0.5, 2.0]), np.array([1.0, 2.5]))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    texts = ["bad day", "evil evil evil", "BAD, worse; evil!", "", None, "good", "bad " * 3000 + "worse"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in T.severity(docs, model).collect()}
    for i, text in enumerate(texts):
        known = {h for _, _, hs in words_of([text]) for h in hs.tolist()}
        z = sum(weight.get(h, 0.0) for h in known)
        above = [1 / (1 + math.exp(-(z - t))) for t in (1.0, 2.5)] if known else [0.0, 0.0]
        assert abs(got[i]["expected_severity"] - sum(above)) < 1e-9 and abs(got[i]["p_toxic"] - above[0]) < 1e-9
        likely = [1 - above[0], above[0] - above[1], above[1]]
        assert got[i]["grade"] == likely.index(max(likely)) and got[i]["rejected"] == (above[0] >= T.REJECT)
