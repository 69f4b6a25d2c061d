"""Toxicity by cumulative-link ordinal regression over sparse text features (operator 6).

Severity grades are ordered 0 < 1 < 2; the labels only tell toxic from not, so
toxic rows are graded by how many kinds of marker words they hold. One weight vector over word
features is shared by all thresholds: P(grade > j) = sigmoid(x.w - theta_j),
theta increasing. A document's expected severity is the sum of these
probabilities. Features are word hashes (64 bits), present or absent; the fit
takes a bounded sample of labelled rows and keeps the words that tell toxic
rows apart, the prediction reads every word of every text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.frames import bounded_batches, pick, stored
from riskspark.llm.textbuf import mix64, words_of

#: Bound of the labelled sample; all labelled rows are used while there are fewer.
SAMPLE_DOCS = 10_000
MAX_FEATURES = 2_048
MIN_DOCS = 5
#: Share of two texts' words that both hold, from which they are near copies.
ALIKE = 0.8
#: Penalty of squared weights, and steps of the optimiser.
RIDGE = 0.05
STEPS = 400
#: A document is rejected if grade 1 or worse is at least this likely.
REJECT = 0.5


class OrdinalModel:
    """Word hashes (sorted), their weights and the thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def score(self, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Sum of the weights of the known words that each text holds."""
        if not len(self.features) or not len(hashes):
            return np.zeros(len(counts))
        place = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = np.flatnonzero(self.features[place] == hashes)
        doc = np.repeat(np.arange(len(counts)), counts)[hit]
        pairs = np.unique(np.stack([doc, place[hit]]), axis=1)
        return np.bincount(pairs[0], weights=self.weights[pairs[1]], minlength=len(counts))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each text and threshold."""
        z = np.clip(np.subtract.outer(score, self.thresholds), -40, 40)
        return 1 / (1 + np.exp(-z))


def toxic_labels(labels: DataFrame, id_col: str = "doc_id", toxic_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic) from the labels, 0 or 1. Rows without an id or a label are left out; of several rows of an id
    the highest label counts."""
    rows = pick(labels, doc_id=id_col, toxic=toxic_col)
    return (rows.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))


def _sample(docs: DataFrame, graded: DataFrame, id_col: str, text_col: str, bound: int):
    """Labels and distinct word hashes of the ``bound`` labelled rows with the smallest id hash."""

    def words(batches):
        import pyarrow as pa
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for first, n, hashes in words_of(batch.column(2).cast("binary").to_pylist()):
                at = np.append(0, np.cumsum(n))
                rows = [np.unique(hashes[s:e]).tobytes() for s, e in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), marks.slice(first, len(n)), pa.array(rows, pa.binary())],
                    names=["key", "toxic", "words"])

    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    # the labels of rows at hand; a hash limit lets little more than the bound through, so the limit and the
    # broadcast below are of a known size whatever the number of labels
    place = F.xxhash64("doc_id")
    here = stored(graded.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    share = min(1.0, 1.2 * bound / max(here.count(), 1))
    chosen = (here.where(place.cast("double") / float(1 << 64) + 0.5 <= share)
              .orderBy(place, "doc_id").limit(bound))
    # ids may repeat: the bound holds for rows, by id hash, id and text hash; equal rows count once
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("th"))
    keys = (rows.select("doc_id", "th").join(F.broadcast(chosen), "doc_id").distinct()
            .orderBy(place, "doc_id", "th").limit(bound))
    picked = (rows.join(F.broadcast(keys), ["doc_id", "th"])
              .select(F.xxhash64("doc_id", "th").alias("key"), F.col("toxic").cast("int"), F.col("text").cast("string")))
    got = (picked.mapInArrow(words, "key long, toxic int, words binary")
           .groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words")))
    out = sorted((r["key"], r["toxic"], bytes(r["words"])) for r in got.toLocalIterator())
    return np.array([g for _, g, _ in out], dtype=np.int64), [np.frombuffer(w, dtype="<u8") for _, _, w in out]


def _pairs(own: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pairs of texts of one key whose numbers of words allow near copies, as smaller * texts + larger. Texts of one key
    share a rare word, so there are few."""
    order = np.lexsort((own, key))
    own, key = own[order], key[order]
    out, i = [], np.arange(len(own))
    while True:
        gap = len(out) + 1
        i = i[i + gap < len(own)]
        i = i[key[i] == key[i + gap]]
        if not len(i):
            break
        a, b = own[i], own[i + gap]
        fit = np.minimum(n[a], n[b]) >= ALIKE * np.maximum(n[a], n[b])
        out.append(a[fit] * len(n) + b[fit])
    return np.concatenate([np.zeros(0, dtype=np.int64), *out])


def _alike(words: list[np.ndarray], bands: int = 10, rows: int = 3) -> np.ndarray:
    """Weight of each text: one over the size of its group of near copies within the sample.

    Texts that agree on three min-hashes over their rare words (in 1 % of the texts at most) are compared, and grouped if
    the Jaccard similarity of all their words is at least ``ALIKE``: a shared rare word alone groups none.
    """
    n = np.array([len(w) for w in words], dtype=np.int64)
    if not n.sum():
        return np.ones(len(words))
    flat, doc = np.concatenate(words), np.repeat(np.arange(len(words)), n)
    _, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    inverse, at = inverse.astype(np.int32), np.append(0, np.cumsum(n))
    rare = np.flatnonzero(df[inverse] <= max(2, len(words) // 100))
    flat, doc = flat[rare], doc[rare]
    if not len(flat):
        return np.ones(len(words))
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    own, pairs = doc[start], np.zeros(0, dtype=np.int64)
    for band in range(bands):
        key = np.zeros(len(start), dtype=np.uint64)
        for row in range(rows):
            low = np.minimum.reduceat(mix64(flat + np.uint64(1 + band * rows + row)), start)
            key = mix64(key ^ low)
        pairs = np.union1d(pairs, _pairs(own, key, n))
    left, right = np.divmod(pairs, len(words))
    keep = np.zeros(len(pairs), dtype=bool)
    held = np.zeros(len(df), dtype=bool)
    edge = np.flatnonzero(np.diff(left, prepend=-1, append=len(words)))
    for lo, hi in zip(edge, edge[1:], strict=False):  # a text against all it may be like
        a, others = left[lo], right[lo:hi]
        held[inverse[at[a]:at[a + 1]]] = True
        both = np.array([np.count_nonzero(held[inverse[at[b]:at[b + 1]]]) for b in others])
        held[inverse[at[a]:at[a + 1]]] = False
        keep[lo:hi] = both >= ALIKE * (n[a] + n[others] - both)
    left, right, label = left[keep], right[keep], np.arange(len(words))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return 1 / np.bincount(label, minlength=len(words))[label]


def _grade(toxic: np.ndarray, words: list[np.ndarray], features: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Severity grades: 0 for not toxic; a toxic row is 1, or 2 if it holds more kinds of marker words than half of
    the toxic rows with any. Markers are the selected words that speak for toxic."""
    marks = features[good]
    kinds = np.array([int(np.isin(w, marks).sum()) for w in words])
    some = kinds[(toxic > 0) & (kinds > 0)]
    middle = np.median(some) if len(some) else 0
    return np.where(toxic > 0, np.where((kinds > middle) & (kinds > 1), 2, 1), 0)


def _select(toxic: np.ndarray, words: list[np.ndarray], once: np.ndarray, max_features: int, min_docs: int):
    """The words that tell toxic rows apart beyond chance, whether they speak for toxic, and their (doc, feature) pairs.

    Twice the log-likelihood ratio of a word's share must exceed what the best of all words reaches by chance, so
    a label without a trace in the words leaves none. Near copies of a text count as one.
    """
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.concatenate(words) if len(words) else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(words)), n)
    found, inverse = np.unique(flat, return_inverse=True)
    bad = np.bincount(inverse, weights=((toxic > 0) * once)[doc], minlength=len(found))
    every = np.bincount(inverse, weights=once[doc], minlength=len(found))
    share = float(((toxic > 0) * once).sum() / max(once.sum(), 1e-9))
    good = every - bad
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(bad > 0, bad * np.log(bad / (every * share)), 0)
                 + np.where(good > 0, good * np.log(good / (every * (1 - share))), 0))
    g[every < min_docs] = 0
    limit = 2 * np.log(10 * max(len(found), 1))
    best = np.argsort(-g, kind="stable")[:max_features]
    best = np.sort(best[g[best] > limit])
    place = np.full(len(found), -1)
    place[best] = np.arange(len(best))
    hit = np.flatnonzero(place[inverse] >= 0)
    return found[best], bad[best] > every[best] * share, doc[hit], place[inverse][hit]


def fit_sample(toxic: np.ndarray, words: list[np.ndarray], max_features: int = MAX_FEATURES,
               min_docs: int = MIN_DOCS, ridge: float = RIDGE, steps: int = STEPS) -> OrdinalModel:
    """Maximum penalised likelihood of the proportional-odds model, by Adam steps on the whole sample."""
    if not len(toxic) or (toxic > 0).all() or not (toxic > 0).any():
        never = 40.0 if not (toxic > 0).any() else -40.0
        return OrdinalModel(np.zeros(0, dtype=np.uint64), np.zeros(0), np.array([never]))
    once = _alike(words)
    features, speaks, doc, col = _select(toxic, words, once, max_features, min_docs)
    grade = _grade(toxic, words, features, speaks)
    top = int(grade.max())
    share = np.array([(grade > j).mean() for j in range(top)])
    share = np.minimum.accumulate(np.clip(share, 1e-6, 1 - 1e-6))
    theta = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(theta), 1e-3))  # theta_j = theta_0 + sum of exp(gap): always in order
    par = np.concatenate([np.zeros(len(features)), theta[:1], gaps])
    m, v = np.zeros_like(par), np.zeros_like(par)
    f, rows = len(features), np.arange(len(grade))
    for step in range(1, steps + 1):
        w = par[:f]
        theta = par[f] + np.concatenate([[0.0], np.cumsum(np.exp(par[f + 1:]))])
        x = np.bincount(doc, weights=w[col], minlength=len(grade))
        s = 1 / (1 + np.exp(-np.clip(np.subtract.outer(x, theta), -40, 40)))
        edge = np.concatenate([np.ones((len(x), 1)), s, np.zeros((len(x), 1))], axis=1)
        p = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-12)
        slope = edge * (1 - edge)
        d_low, d_high = slope[rows, grade] / p, slope[rows, grade + 1] / p
        d_low, d_high = d_low * once, d_high * once
        gx = d_high - d_low
        d_theta = np.zeros(top)
        np.add.at(d_theta, grade[grade > 0] - 1, d_low[grade > 0])
        np.add.at(d_theta, grade[grade < top], -d_high[grade < top])
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, weights=gx[doc], minlength=f) + ridge * w, tail[:1],
                               tail[1:] * np.exp(par[f + 1:])])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        par = par - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    theta = par[f] + np.concatenate([[0.0], np.cumsum(np.exp(par[f + 1:]))])
    return OrdinalModel(features, par[:f], theta)


def fit(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        sample_docs: int = SAMPLE_DOCS) -> OrdinalModel:
    """Fit on at most ``sample_docs`` labelled rows: of rows that share an id each text counts, of equal rows one.

    Null texts and unlabelled rows teach nothing. Without toxic rows (an empty table too) nothing is ever rejected.
    """
    return fit_sample(*_sample(docs, graded, id_col, text_col, sample_docs))


def _scorer(sent, reject: float):
    def score(texts) -> list[tuple[int, np.ndarray, np.ndarray]]:
        model: OrdinalModel = sent.value
        return [(first, n, model.above(model.score(n, hashes))) for first, n, hashes in words_of(texts)]
    return score


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
             reject: float = REJECT) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_severity, p_toxic, grade, rejected.

    ``grade`` is the most likely grade. Null or empty text has no words: severity 0, not rejected.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        score = _scorer(sent, reject)
        for batch in batches:
            for first, n, above in score(batch.column(1).cast("binary").to_pylist()):
                above[n == 0] = 0.0
                likely = -np.diff(np.concatenate([np.ones((len(n), 1)), above, np.zeros((len(n), 1))], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(above.sum(axis=1)), pa.array(above[:, 0]),
                     pa.array(likely.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= reject)],
                    names=["doc_id", "expected_severity", "p_toxic", "grade", "rejected"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject: a filter where the rows are read.

    Null and empty texts stay, equal rows share their fate, an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        score = _scorer(sent, reject)
        for batch in batches:
            keep = [(n == 0) | (above[:, 0] < reject)
                    for _, n, above in score(batch.column(at).cast("binary").to_pylist())]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
