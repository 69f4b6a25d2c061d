import random

import numpy as np
from pyspark.sql import functions as F

from riskspark.llm import near_dedup as N
from riskspark.llm.textbuf import words_of


def vector(text, idf):
    hashes = np.concatenate([h for _, _, h in words_of([text])])
    return N.shingles(np.array([len(hashes)]), hashes, idf)[1:]


def brute_classes(texts, idf, threshold=0.8):
    vectors = [dict(zip(*(a.tolist() for a in vector(t or "", idf)), strict=True)) for t in texts]
    label = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            a, b = vectors[x], vectors[y]
            low = sum(min(a[k], b[k]) for k in a if k in b)
            if a and b and low / (sum(a.values()) + sum(b.values()) - low) >= threshold and label[x] != label[y]:
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = [new if c == old else c for c in label]
    return label


def near_copy(rng, text, share):
    from .conftest import word
    return " ".join(word(rng) if rng.random() < share else w for w in text.split())


def test_equals_brute_force(spark, frame, monkeypatch):
    from .conftest import prose
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(30, 150)) for _ in range(60)]
    for base in texts[:25]:
        texts += [near_copy(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(rng.randint(1, 4))]
    hub = prose(rng, 200)
    texts += [near_copy(rng, hub, 0.015) for _ in range(40)]  # a large group whose members differ from each other
    texts += [texts[0], None, "", "one two", "one two", "one  two"]
    idf = N.word_idf(spark.createDataFrame([(t or "",) for t in texts], "text string"))
    want = brute_classes(texts, idf)
    for part in (512, 16):  # at 16 texts a part, families are split into tiles
        monkeypatch.setattr(N, "PART_TEXTS", part)
        got = {r["doc_id"]: r for r in N.near_classes(frame(texts)).collect()}
        assert [got[i]["class_id"] for i in range(len(texts))] == want
        assert [got[i]["kept"] for i in range(len(texts))] == [want[i] == i for i in range(len(texts))]
        assert all(got[i]["class_size"] == want.count(want[i]) for i in got)


def test_samples_agree_as_often_as_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 2 ** 63, 300, dtype=np.uint64))
    a, b = rng.gamma(2, 1, 300), rng.gamma(2, 1, 300)
    a[:60], b[-60:] = 0, 0
    one, two = np.flatnonzero(a), np.flatnonzero(b)
    s = [N.samples(np.zeros(len(k), dtype=np.int64), keys[k], w[k], 250)[1][0] for k, w in ((one, a), (two, b))]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (200, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["comp"] for r in N.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert N.components(df.limit(0)).count() == 0


def test_keep_one_keeps_a_row_of_every_class(frame):
    from .conftest import prose
    rng = random.Random(12)
    base = prose(rng, 200)
    texts = [base, near_copy(rng, base, 0.005), base, "alone", None, None, "", base]
    docs = frame(texts, ids=[4, 3, 7, 1, 2, None, 9, 3])
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "1", "2", "None", "9"])


def test_edge_rows(edges, nothing, all_null, edge_texts):
    got = N.near_classes(edges).collect()
    assert len(got) == len(edge_texts)
    assert N.near_classes(nothing).count() == 0 and N.keep_one(nothing).count() == 0
    assert [(r["class_id"], r["class_size"], r["kept"]) for r in N.near_classes(all_null).collect()] == [(None, 1, True)] * 3
    assert N.keep_one(all_null).count() == 3
    assert N.keep_one(edges).select(F.count(F.lit(1))).first()[0] < len(edge_texts)


def test_star_rounds_write_few_files(spark, monkeypatch):
    """A round of a few rows writes a few files a core, whatever the number of shuffle partitions."""
    from riskspark.llm import near_dedup as N
    files, real = [], N.stored

    def watched(df, name, *by):
        out = real(df, name, *by)
        if name == "stars":
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(N, "stored", watched)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        chains = spark.range(0, 400).where("id % 10 < 9").selectExpr("id AS u", "id + 1 AS v")
        found = {(r["node"], r["comp"]) for r in N.components(chains).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {(i, i // 10 * 10) for i in range(400) if i % 10}
    assert files and max(files) <= 4 * spark.sparkContext.defaultParallelism
