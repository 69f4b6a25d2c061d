import hashlib
import random

import numpy as np

from riskspark.llm import line_dedup as L


def key(line):
    line = line.strip("\x20\x09\x0a\x0b\x0c\x0d")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(texts, ids, points=40, docs=5):
    low = lambda i: -2 ** 63 if i is None else i
    holders = {}
    for i, t in zip(ids, texts, strict=True):
        for line in (t or "").split("\n"):
            if len(key(line)) >= points:
                holders.setdefault(key(line), set()).add(low(i))
    out = []
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == low(i)]
        out.append((str(i), len(lines), len(lines) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def have(df):
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect())


def test_equals_brute_force(frame):
    from .conftest import prose
    rng = random.Random(9)
    shared = [prose(rng, n) for n in (8, 12, 20, 30)] + ["é" * 39, "é" * 40, "日本" * 25, "x" * 39 + "\x85"]
    texts = []
    for d in range(60):
        lines = [rng.choice(["", " ", "\t", "\r"]) + rng.choice([s, s.upper(), s.title()]) + rng.choice(["", " \x0b", "\r"])
                 for s in shared if rng.random() < 0.2 + 0.1 * (d % 3)]
        lines += [prose(rng, 10), "", prose(rng, 3)]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", shared[0] + "\n" + shared[0]]
    ids = [*range(60), None, 70, None, 20]
    assert have(L.dedup_lines(frame(texts, ids=ids))) == brute(texts, ids)
    assert have(L.dedup_lines(frame(texts, ids=ids), min_points=3, min_docs=2)) == brute(texts, ids, 3, 2)


def test_edge_rows(edges, nothing, all_null, edge_texts, edge_ids):
    assert have(L.dedup_lines(edges, min_docs=2)) == brute(edge_texts, edge_ids, docs=2)
    assert L.dedup_lines(nothing).count() == 0
    assert {(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in L.dedup_lines(all_null).collect()} == {(1, 0, "")}


def test_twice_bloom_misses_no_repeat():
    rng = np.random.default_rng(2)
    once, again = np.split(rng.permutation(20_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), [15_000])
    bloom = L.TwiceBloom(20_000)
    bloom.add(np.concatenate([once[:8_000], again]), np.zeros(13_000, dtype=bool))
    bloom.add(np.concatenate([once[8_000:], again]), np.zeros(12_000, dtype=bool))
    assert bloom.suspects(again).all()
    assert bloom.suspects(once).mean() < 0.01
    several = L.TwiceBloom(10)
    several.add(once[:5], np.array([True] * 5))
    assert several.suspects(once[:5]).all()


def test_rows_without_an_id_are_told_apart_by_text(frame):
    import time

    from .conftest import prose
    rng = random.Random(21)
    shared = [prose(rng, 15) for _ in range(30)]

    def took(n):
        texts = ["\n".join([*rng.sample(shared, 12), prose(rng, 5)]) for _ in range(n)]
        texts += texts[:n // 4]
        ids = [None] * len(texts)
        ids[:6] = range(6)
        begin = time.time()
        found = have(L.dedup_lines(frame(texts, ids=ids)))
        took_s = time.time() - begin
        assert found == brute(texts, ids)
        return took_s

    took(50)
    assert took(3000) < 6 * took(500) + 3
