"""Every stage on the smallest table, against what its operator says of the same rows."""

import corpus_pipeline as P

from riskspark.llm import decontaminate, near_dedup, toxicity
from riskspark.llm.frames import stored
from riskspark.llm.queries import REGISTRY, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_dedup", "decontaminate", "mixing", "token_output"]
    frames = [docs]
    for name, stage in P.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF), f"test-{name}"))
    assert all(f.columns == docs.columns for f in frames[1:-1])
    ids = [sorted(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]

    model = toxicity.fit(docs, toxicity.toxic_labels(table(spark, SF, "labels")))
    bad = {r["doc_id"] for r in toxicity.severity(docs, model).where("rejected").collect()}
    assert ids[1] == [i for i in ids[0] if i not in bad]
    assert ids[2] == sorted(r["doc_id"] for r in near_dedup.near_classes(frames[1]).where("kept").collect())
    found = decontaminate.contamination(frames[2], table(spark, SF, "benchmark"))
    dirty = {r["doc_id"] for r in found.where("contaminated").collect()}
    assert dirty and ids[3] == [i for i in ids[2] if i not in dirty]
    assert set(ids[4]) <= set(ids[3])
    assert ids[5] == ids[4]
    rows = sorted((r["start"], r["n_tokens"]) for r in frames[5].collect())
    assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_run_and_entry(spark):
    import __spark_entry__ as entry
    queries = entry.queries()
    assert {*REGISTRY, "pipeline"} <= set(queries)
    assert queries["pipeline"](spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {"op2_decontaminate", "op7_exact_dedup", "op8_line_dedup"} <= set(entry.oracle_sql())


def test_stages_take_clashing_columns_and_nulls(spark, edges, nothing, all_null):
    for docs in (edges, nothing, all_null):
        for _, stage in P.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), "test-edge")
            assert docs.columns == edges.columns
        assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_step_memory_is_bounded():
    """What a worker holds for 6 MB of texts while it hashes words and draws samples: a step's arrays, not a batch's."""
    import random
    import tracemalloc

    import numpy as np

    from riskspark.llm import near_dedup as N
    from riskspark.llm.textbuf import words_of
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=300)).encode() for _ in range(3000)]
    idf = np.ones(1 << N.SLOT_BITS, dtype=np.float32)
    tracemalloc.start()
    for _, n, hashes in words_of(texts):
        pass
    hashed = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    for _, n, hashes in words_of(texts, N.STEP_BYTES):
        N.samples(*N.shingles(n, hashes, idf), 2)
    drawn = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hashed < 24 << 20 and drawn < 24 << 20, (hashed, drawn)
