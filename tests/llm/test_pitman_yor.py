"""Counts and base scores by brute force; seatings against their exact law; scores against a sampler in plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.llm import pitman_yor as py


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [b""]


def base(rows):
    """Sorted (id, held out, tokens, known, training tokens, base score) by the definition."""
    count = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return sorted((str(i), is_held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)


def shown(found):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in found.collect())


def test_base_columns_and_edge_rows(edges, edge_texts, edge_ids, nothing, all_null):
    found = py.scores(edges, held_out())
    assert shown(found) == base(list(zip(edge_ids, edge_texts, strict=True)))
    assert all(r["score"] < 0 for r in found.collect())
    assert py.scores(nothing, held_out()).count() == 0
    assert shown(py.scores(all_null, held_out())) == base([(None, None)] * 3)


def test_a_text_longer_than_a_block_is_scored_whole(frame):
    rng = random.Random(1)
    long = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(1_500_000))
    assert len(long) > 2 * py.BLOCK_BYTES / 1.2
    texts = [long, "alpha beta", None]
    assert shown(py.scores(frame(texts), held_out())) == base(list(enumerate(texts)))


def test_without_training_rows(frame):
    found = py.scores(frame(["a b c", "d"]), F.lit(True)).collect()
    assert {(r["train_tokens"], r["base_score"], r["n_known"]) for r in found} == {(0, 0.0, 0)}
    assert all(abs(r["score"]) < 1e-6 for r in found)


@pytest.mark.parametrize("customers", [2, 3, 40])
def test_gibbs_reaches_the_law_of_tables(customers):
    d, weight, n = 0.6, 0.7, 4000
    rows = np.full(n, customers)
    seats = py.Seating(rows, np.zeros(n, dtype=np.int64), np.full(n, weight), np.array([0.0]), np.array([True]), d, 1.0,
                       np.random.default_rng(3))
    for _ in range(200 if customers > 3 else 12):  # a sweep re-seats 16 customers of a dish
        seats.sweep()
    law = np.zeros(customers + 1)  # weights of t tables: seat one customer after another
    law[1] = 1.0
    for m in range(1, customers):
        law[1:] = law[1:] * np.maximum(m - d * np.arange(1, customers + 1), 0) + np.append(0, law[1:-1]) * weight
        law /= law.sum()
    expected = (law * np.arange(customers + 1)).sum()
    assert seats.tables().mean() == pytest.approx(expected, rel=0.03)
    used = [seats.size[a:b] for a, b in zip(seats.begin, seats.begin[1:], strict=False)]
    assert all(u.sum() == customers for u in used) and [int((u > 0).sum()) for u in used] == seats.t.tolist()


def test_a_sweep_seats_all_customers_of_a_large_dish_anew():
    n, d, share, total = 3000, 0.6, 0.01, 4000.0
    seats = py.Seating(np.full(400, n), np.zeros(400, dtype=np.int64), np.full(400, share), np.array([0.0]),
                       np.array([True]), d, 1.0, np.random.default_rng(4))
    seats.total[:] = total  # what the other dishes have changed to
    seats.sweep()
    law = np.zeros(n + 1)
    law[1] = 1.0
    for m in range(1, n):
        law[1:] = law[1:] * np.maximum(m - d * np.arange(1, n + 1), 0) + np.append(0, law[1:-1]) * (1 + d * total) * share
        law /= law.sum()
    t = np.arange(n + 1)
    mean = (law * t).sum()
    assert seats.tables().mean() == pytest.approx(mean, rel=0.01)  # 16 customers of 3,000 were re-seated before
    assert seats.tables().std() == pytest.approx(math.sqrt((law * (t - mean) ** 2).sum()), rel=0.15)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(5)
    v = 30
    keys = np.sort(np.concatenate([(u << 32) | np.arange(v) for u in range(4)]))
    counts = rng.integers(0, 9, len(keys))
    counts[keys >> 32 == 3] = 0  # a context that was never seen
    one = (counts > 0).astype(np.int64)
    customers = np.bincount(keys & 0xFFFFFFFF, weights=one, minlength=v).astype(np.int64)
    told = pd.DataFrame({"owner": [0], "words": [py.pack_sorted(np.arange(v))], "tables": [py.pack(customers)]})
    masses = py._parent(0.5, 1.0, v, v)((0,), told)
    total = masses.loc[masses["owner"] == -1, "n_tables"].iloc[0]
    parent = ((1.0 + 0.5 * total) / (v + 1), 1.0 + customers.sum())
    rows = masses.loc[masses["owner"] == 0, ["span", "mass"]].to_dict("records")
    mine = py._Owner(keys, counts, rows, py.Numbering([], 1), {}, parent, 0.6, 1.0, np.random.default_rng(1))
    mine.sweep()
    p = mine.predictive()
    unknown = parent[0] / parent[1]
    for u in range(4):
        own = keys >> 32 == u
        left = mine.theta + mine.d * mine.seats.total[mine.of[own][0]]
        rest = left * unknown / (mine.theta + mine.customers[mine.of[own][0]])
        assert p[own].sum() + rest == pytest.approx(1.0, abs=1e-9)


class Plain:
    """The same process with every customer seated one by one, in dictionaries."""

    def __init__(self, docs, d, d0, theta=1.0, theta0=1.0, seed=1):
        self.d, self.d0, self.theta, self.theta0, self.rng = d, d0, theta, theta0, random.Random(seed)
        self.low, self.top, self.v = defaultdict(lambda: defaultdict(list)), defaultdict(list), 0
        self.pairs = [p for doc in docs for p in zip([b"", *doc[:-1]], doc, strict=True)]
        self.v = len({w for _, w in self.pairs})
        for u, w in self.pairs:
            self.seat(u, w)

    def p0(self, w):
        own = self.top[w]
        tables, n = sum(map(len, self.top.values())), sum(map(sum, self.top.values()))
        return (sum(own) - self.d0 * len(own) + (self.theta0 + self.d0 * tables) / (self.v + 1)) / (self.theta0 + n)

    def p(self, u, w):
        own = self.low[u]
        tables, n = sum(map(len, own.values())), sum(map(sum, own.values()))
        return (sum(own[w]) - self.d * len(own[w]) + (self.theta + self.d * tables) * self.p0(w)) / (self.theta + n)

    def choose(self, sizes, d, fresh):
        weights = [s - d for s in sizes] + [fresh]
        return self.rng.choices(range(len(weights)), weights)[0]

    def seat(self, u, w):
        own = self.low[u]
        at = self.choose(own[w], self.d, (self.theta + self.d * sum(map(len, own.values()))) * self.p0(w))
        if at < len(own[w]):
            own[w][at] += 1
            return
        own[w].append(1)
        tables = sum(map(len, self.top.values()))
        at = self.choose(self.top[w], self.d0, (self.theta0 + self.d0 * tables) / (self.v + 1))
        if at < len(self.top[w]):
            self.top[w][at] += 1
        else:
            self.top[w].append(1)

    @staticmethod
    def leave(sizes, rng):
        at = rng.choices(range(len(sizes)), sizes)[0]
        sizes[at] -= 1
        if not sizes[at]:
            del sizes[at]
            return True
        return False

    def sweep(self):
        for u, w in self.pairs:
            if self.leave(self.low[u][w], self.rng):
                self.leave(self.top[w], self.rng)
            self.seat(u, w)


def test_scores_are_those_of_a_plain_sampler(frame):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    follow = {w: rng.sample(words, 4) for w in words}
    texts = []
    for _ in range(70):
        text = [rng.choice(words)]
        while len(text) < 12:
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.8 else rng.choice(words))
        texts.append(" ".join(text))
    found = {r["doc_id"]: r["score"] for r in py.scores(frame(texts), held_out()).collect()}
    docs = [tokens(t) for t in texts]
    train = [t for i, t in enumerate(docs) if not is_held(i)]
    pairs = Counter(p for doc in train for p in zip([b"", *doc[:-1]], doc, strict=True))
    count = Counter(w for doc in train for w in doc)
    share = lambda c: py._discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    plain = Plain(train, share(pairs), share(count))
    total = defaultdict(float)
    for sweep in range(18):
        plain.sweep()
        if sweep >= 6:
            for i, doc in enumerate(docs):
                for j, p in enumerate(zip([b"", *doc[:-1]], doc, strict=True)):
                    total[i, j] += plain.p(*p) / 12
    expected = {i: sum(math.log10(total[i, j]) for j in range(len(doc))) for i, doc in enumerate(docs)}
    held = [i for i in found if is_held(i)]
    for ids in (held, [i for i in found if i not in held]):
        assert sum(found[i] for i in ids) == pytest.approx(sum(expected[i] for i in ids), rel=0.02)
    assert all(found[i] == pytest.approx(expected[i], rel=0.1) for i in found)
    base_score = {r["doc_id"]: r["base_score"] for r in py.scores(frame(texts), held_out()).collect()}
    assert sum(found[i] for i in held) > sum(base_score[i] for i in held)


def test_hot_contexts_are_dealt_by_word(frame, spark):
    totals = [{"owner": 0, "n": 50, "hot": [3], "hot_counts": [900]}]
    numbering = py.Numbering(totals, 8)
    hot = (np.int64(3) << 32) | np.arange(50)
    cold = (np.int64(4) << 32) | np.arange(50)
    assert len(set(numbering.owner(hot).tolist())) > 4 and len(set(numbering.owner(cold).tolist())) == 1
    texts = [" ".join(["the w%d" % (i * j % 37) for j in range(30)]) for i in range(40)]
    again = [sorted((r["doc_id"], r["score"]) for r in py.scores(frame(texts), held_out()).collect()) for _ in range(2)]
    assert again[0] == again[1]
    assert shown(py.scores(frame(texts), held_out())) == base(list(enumerate(texts)))
