"""Language-model scores from a hierarchical Pitman-Yor process (operator 11).

Every word that stands before another one has a restaurant; a token is a customer that asks for a dish, the word. All
these restaurants share one parent, whose customers are their tables; its own base is uniform over the known words and
one unknown word. A token's probability is the Chinese-restaurant predictive
    p(w | u) = (c_uw - d t_uw + (theta + d t_u) p(w)) / (theta + c_u),
the same form one level up for p(w). Seatings are sampled by Gibbs steps that seat all customers of a dish anew;
predictive probabilities are averaged over samples.

How the work is spread (all exchanged lists are sorted, delta-coded and packed):

1. Blocks of some MB of text are tokenised where they are read: distinct word hashes and the token stream.
2. Owners of hash ranges count the words, number them and answer each block with numbers and counts.
3. A block sends its distinct (context, word) pairs to the owner of the context. Contexts that are hot are dealt over the
   owners by the word. An owner merges the pairs: its restaurants.
4. Owners tell the parent, dealt by word, their tables per word and get the word's share of the parent. Then they sweep.
   Given the parent, restaurants of different contexts are independent; the few totals of hot ones are exchanged.
5. The owner answers every pair of every block with its averaged probability, and the blocks add them up by document.

A sweep re-seats all customers of every dish: it draws the dish's number of tables, all that the predictive needs, from its
conditional law (``Seating``), so its cost doesn't grow with the customers of a frequent pair.
"""

from __future__ import annotations

import gc
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.frames import arrow_batch, id_back, id_key, pick, small_batches, stored
from riskspark.llm.textbuf import LOWER, distinct, mix64, pieces, ranges, span_hash

BLOCK_BYTES = 4 << 20
#: Training and held-out tokens whose pairs one owner holds, words that one owner counts, words of one parent range.
OWNER_TOKENS, OWNER_WORDS, PARENT_WORDS = 1 << 21, 1 << 21, 1 << 18
BURN_IN, SAMPLES, ROUNDS = 1, 2, 2
#: Customers of a dish up to which the law of its tables is tabled; cells of a block of such laws.
TABLED, CHUNK = 512, 1 << 18
#: Concentrations of the context restaurants and of their parent; discounts come from the counts of counts.
THETA, THETA_PARENT = 1.0, 1.0
SEED = 11
_END = np.uint64(0)
_SOLID = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def _z():
    import zstandard
    return zstandard


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    kind = f"<u{8 if len(values) and int(values.max()) >> 32 else 4}"
    raw = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), int(kind[-1])).T)
    return kind[-1].encode() + _z().ZstdCompressor(level=1).compress(raw.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    size = int(blob[:1])
    raw = np.frombuffer(_z().ZstdDecompressor().decompress(blob[1:]), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{size}").ravel().astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob))


def _floats(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values.astype("<f4").view(np.uint8).reshape(len(values), 4).T)
    return _z().ZstdCompressor(level=1).compress(raw.tobytes())


def _from_floats(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(_z().ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<f4").ravel().astype(np.float64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, hashes of the lower-cased words)."""
    buf = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    edge = np.zeros(len(buf) + 2, dtype=np.int8)
    edge[1:-1] = _SOLID[buf]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    bounds = np.cumsum([len(b) + 1 for b in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return counts.astype(np.int64), span_hash(buf, starts, ends)


BLOCK = ("block long, rows array<long>, ids array<long>, held binary, sizes binary, words binary, train binary, "
         "stream binary, tokens long, train_tokens long, n_words long")


def _block(number: int, entries: list[tuple], counts: np.ndarray, hashes: np.ndarray) -> tuple:
    """A block record of entries (row, id, held, first context, ends); an entry's stream starts with its context."""
    ends = np.array([e[4] for e in entries])
    sizes = counts + 1 + ends
    at = np.cumsum(sizes) - sizes
    tokens = np.full(int(sizes.sum()), _END, dtype=np.uint64)
    tokens[at] = np.array([e[3] for e in entries], dtype=np.uint64)
    tokens[ranges(at + 1, counts)] = hashes
    words, _, stream = distinct(tokens)
    learns = np.repeat(~np.array([e[2] for e in entries]), sizes)
    learns[at] = False
    train = np.bincount(stream[learns], minlength=len(words))
    return (number, [e[0] for e in entries], [e[1] for e in entries],
            np.array([e[2] for e in entries], dtype=np.uint8).tobytes(), pack(sizes), words.tobytes(), pack(train),
            pack(stream), int(len(tokens) - len(entries)), int(learns.sum()), len(words))


def _blocks(batches):
    from pyspark import TaskContext
    part, seq, row = TaskContext.get().partitionId(), 0, 0
    entries, texts, size = [], [], 0

    def flush():
        nonlocal entries, texts, size, seq
        out = arrow_batch(BLOCK, [_block((part << 32) | seq, entries, *word_hashes(texts))])
        entries, texts, size, seq = [], [], 0, seq + 1
        return out

    for batch in batches:
        for id_, text, held in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist(),
                                   batch.column(2).to_pylist(), strict=True):
            key, row = (part << 40) | row, row + 1
            if entries and size + len(text) > BLOCK_BYTES:
                yield flush()
            if len(text) <= BLOCK_BYTES:
                entries.append((key, id_, held, _END, True))
                texts.append(text)
                size += len(text)
                continue
            cut, context = pieces(text, BLOCK_BYTES, lambda b: not _SOLID[b]), _END
            for i, piece in enumerate(cut):  # a long text goes on in the next block
                counts, hashes = word_hashes([piece])
                yield arrow_batch(BLOCK, [_block((part << 32) | seq, [(key, id_, held, context, i == len(cut) - 1)], counts,
                                            hashes)])
                seq, context = seq + 1, hashes[-1] if len(hashes) else context
    if entries:
        yield flush()


def _word_slices(owners: int):
    def run(batches):
        for batch in batches:
            for block, words, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, train = np.frombuffer(words, dtype="<u8"), unpack(train)
                at = np.searchsorted((words >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32), np.arange(owners + 1))
                yield arrow_batch("owner int, block long, words binary, train binary",
                             [(o, block, words[a:b].tobytes(), pack(train[a:b]))
                              for o, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if b > a])
    return run


WORDS = ("owner int, block long, ranks binary, counts binary, n long, known long, once long, twice long, "
         "hot array<long>, hot_counts array<long>")


def _count_words(hot_limit: float):
    def run(key, pdf):
        """Numbers (within the range) and training counts of the words of every block, and the range's totals."""
        import pandas as pd
        parts = [np.frombuffer(b, dtype="<u8") for b in pdf["words"]]
        found, _, inverse = distinct(np.concatenate(parts))
        counts = np.bincount(inverse, weights=np.concatenate([unpack(b) for b in pdf["train"]]),
                             minlength=len(found)).astype(np.int64)
        at, out = 0, []
        for block, words in zip(pdf["block"], parts, strict=True):
            mine = inverse[at:at + len(words)]
            out.append((key[0], block, pack_sorted(mine), pack(counts[mine]), 0, 0, 0, 0, [], []))
            at += len(words)
        hot = np.flatnonzero(counts > hot_limit)
        out.append((key[0], -1, b"", b"", len(found), int((counts > 0).sum()), int((counts == 1).sum()),
                    int((counts == 2).sum()), hot.tolist(), counts[hot].tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in WORDS.split(", ")])
    return run


class Numbering:
    """Numbers of words: the first of every hash range, and the hot contexts with their training counts."""

    def __init__(self, totals, owners: int):
        self.owners, sizes = owners, np.zeros(max([t["owner"] for t in totals], default=0) + 1, dtype=np.int64)
        for t in totals:
            sizes[t["owner"]] = t["n"]
        self.first, self.n = np.cumsum(sizes) - sizes, int(sizes.sum())
        if self.n >= 1 << 31:
            raise ValueError("a pair of word numbers must fit 63 bits: more than 2**31 different words")
        hot = sorted((int(self.first[t["owner"]]) + r, c) for t in totals
                     for r, c in zip(t["hot"], t["hot_counts"], strict=True))
        self.hot = np.array([h for h, _ in hot], dtype=np.int64)
        self.hot_counts = np.array([c for _, c in hot], dtype=np.int64)

    def owner(self, keys: np.ndarray) -> np.ndarray:
        """The owner of a pair: by its context, or by its word if the context is hot."""
        context, word = keys >> 32, keys & 0xFFFFFFFF
        deal = np.where(np.isin(context, self.hot), word, context)
        return (mix64(deal.astype(np.uint64)) % np.uint64(self.owners)).astype(np.int64)


class _Pairs:
    """The (context, word) pairs of a block in the order in which they are asked: by owner, then by key."""

    def __init__(self, numbering: Numbering, sizes, stream, answers):
        answers = sorted(answers, key=lambda a: a["owner"])
        ids = np.concatenate([numbering.first[a["owner"]] + unpack_sorted(a["ranks"]) for a in answers])
        self.count = np.concatenate([unpack(a["counts"]) for a in answers])
        self.sizes, self.stream = unpack(sizes), unpack(stream)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.scored = np.ones(len(self.stream), dtype=bool)
        self.scored[self.begin] = False
        place = np.flatnonzero(self.scored)
        tokens = ids[self.stream]
        keys, _, inverse = distinct((tokens[place - 1] << 32) | tokens[place])
        owner = numbering.owner(keys)
        order = np.argsort(owner, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.owner, self.of_token = keys[order], owner[order], rank[inverse]

    def slices(self):
        at = np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1]))
        return zip(self.owner[at].tolist(), at.tolist(), np.append(at[1:], len(self.keys)).tolist(), strict=True)


def _ask(sent):
    def run(batches):
        for batch in batches:
            for block, held, sizes, stream, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = _Pairs(sent.value, sizes, stream, answers)
                learns = np.repeat(np.frombuffer(held, dtype=np.uint8) == 0, pairs.sizes)[pairs.scored]
                train = np.bincount(pairs.of_token[learns], minlength=len(pairs.keys))
                yield arrow_batch("owner int, block long, keys binary, train binary",
                             [(o, block, pack_sorted(pairs.keys[a:b]), pack(train[a:b])) for o, a, b in pairs.slices()])
    return run


STATE = ("owner int, span int, words binary, tables binary, keys binary, counts binary, blocks array<long>, "
         "places array<binary>, n_tables long, once long, twice long, hot array<long>, hot_tables array<long>")
_STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _messages(owner: int, words: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """Tables per word of the owner's restaurants, a message for every range of the parent."""
    span = words // PARENT_WORDS
    at = np.searchsorted(span, np.arange(int(span[-1]) + 2)) if len(span) else np.zeros(1, dtype=np.int64)
    return [(owner, s, pack_sorted(words[a:b]), pack(tables[a:b]), None, None, None, None, 0, 0, 0, [], [])
            for s, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if b > a]


def _hot_tables(numbering: Numbering, context: np.ndarray, tables: np.ndarray) -> tuple[list, list]:
    mine = np.isin(context, numbering.hot)
    hot, inverse = np.unique(context[mine], return_inverse=True)
    return hot.tolist(), np.bincount(inverse, weights=tables[mine], minlength=len(hot)).astype(np.int64).tolist()


def _merge(sent):
    def run(key, pdf):
        """An owner's restaurants from the pairs of all blocks, first with one table a dish."""
        import pandas as pd
        pdf = pdf.sort_values("block")
        parts = [unpack_sorted(b) for b in pdf["keys"]]
        keys, _, inverse = distinct(np.concatenate(parts))
        counts = np.bincount(inverse, weights=np.concatenate([unpack(b) for b in pdf["train"]]),
                             minlength=len(keys)).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])
        places = [pack_sorted(inverse[e - len(p):e]) for p, e in zip(parts, ends.tolist(), strict=True)]
        one = (counts > 0).astype(np.int64)
        words, of_pair = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        tables = np.bincount(of_pair, weights=one, minlength=len(words)).astype(np.int64)
        out = _messages(key[0], words, tables)
        out.append((key[0], -1, None, None, pack_sorted(keys), pack(counts), pdf["block"].tolist(), places,
                    int(one.sum()), int((counts == 1).sum()), int((counts == 2).sum()),
                    *_hot_tables(sent.value, keys >> 32, one)))
        return pd.DataFrame(out, columns=_STATE_NAMES)
    return run


@lru_cache(maxsize=4)
def _table_weights(discount: float) -> np.ndarray:
    """log S(n, t) for n <= ``TABLED`` customers at t tables: the sum over their seatings of the product of
    (1 - d)(2 - d)...(size - 1 - d) of every table, by S(n + 1, t) = S(n, t - 1) + (n - d t) S(n, t)."""
    out = np.full((TABLED + 1, TABLED + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, TABLED + 1)
    with np.errstate(divide="ignore"):
        for n in range(1, TABLED):
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], out[n, 1:] + np.log(np.maximum(n - discount * t, 0)))
    return out


def _table_moments(n: np.ndarray, rate: np.ndarray, discount: float, nodes: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(mean, variance) of the tables of dishes with the law S(n, t) rate^t.

    sum over t of S(n, t) rate^t is n! [z^n] exp(rate h(z)), h(z) = (1 - (1 - z)^d) / d; factorial moments put powers of
    rate h(z) before it. The coefficients are contour integrals, taken with z = exp(-q) on a parabola through the saddle.
    """
    low, high = np.full(len(n), np.log(1e-14)), np.full(len(n), np.log(60.0))
    for _ in range(60):
        mid = (low + high) / 2
        q = np.exp(mid)
        beyond = rate * np.exp(-q) * (-np.expm1(-q)) ** (discount - 1) < n
        low, high = np.where(beyond, low, mid), np.where(beyond, mid, high)
    q0 = np.maximum(np.exp(high), 4.0 / n)[:, None]
    y = (np.arange(nodes) + 0.5) / nodes * np.sqrt(40 / (n[:, None] * q0))
    q = q0 * (1 + 1j * y) ** 2
    a = rate[:, None] * (1 - (-np.expm1(-q)) ** discount) / discount
    power = n[:, None] * q + a
    f = np.exp(power - power.real.max(axis=1, keepdims=True)) * (1 + 1j * y)
    whole, one, two = (x.real.sum(axis=1) for x in (f, f * a, f * a * a))
    mean = np.clip(one / whole, 1, n)
    return mean, np.maximum(two / whole + mean - mean ** 2, 0)


class Seating:
    """Tables of dishes with two customers or more. A sweep re-seats all customers of every dish.

    ``restaurant`` numbers the restaurant of every dish, ``total`` holds the tables of each restaurant in all (other
    dishes included), ``fixed`` tells those whose total is not ours alone and stays as told, ``share`` is the parent's
    probability of each dish.

    Nothing outside asks at which table a customer sits, so a sweep draws a dish's number of tables t from its
    conditional law at once: with a Gamma(theta / d + total) variable x for the restaurant (it makes its dishes
    independent) t has weights S(n, t) (d x share)^t. The law is tabled up to ``TABLED`` customers; of larger dishes t - 1,
    a sum of independent 0/1 variables, is drawn from the binomial with its mean and variance.
    """

    def __init__(self, counts, restaurant, share, total, fixed, discount: float, theta: float, rng):
        self.order = np.argsort(-counts, kind="stable")
        self.n, self.of, self.share = counts[self.order], restaurant[self.order], share[self.order]
        self.total, self.fixed, self.d, self.theta, self.rng = total.astype(np.float64), fixed, discount, theta, rng
        weight = (theta + discount * self.total[self.of]) * self.share
        # about the expected number of tables: 1 + weight / d for many customers, all of them for few
        many = 1 + weight * (1 - self.n.astype(float) ** -discount) / discount
        self.t = np.clip(np.rint(1 / np.sqrt(1.0 / self.n.astype(float) ** 2 + 1.0 / many ** 2)), 1, self.n).astype(np.int64)
        self._add(self.t - 1)

    def _add(self, change: np.ndarray) -> None:
        delta = np.bincount(self.of, weights=change, minlength=len(self.total))
        self.total += np.where(self.fixed, 0, delta)

    @property
    def begin(self) -> np.ndarray:
        return np.append(0, np.cumsum(self.t))

    @property
    def size(self) -> np.ndarray:
        """Customers at the tables of one seating with these numbers of tables: some 1/k at the k-th one to open."""
        begin, t = self.begin, self.t
        place = np.arange(begin[-1]) - np.repeat(begin[:-1], t)
        harmonic = np.add.reduceat(1.0 / (place + 1), begin[:-1]) if len(t) else np.zeros(0)
        size = 1 + np.floor(np.repeat((self.n - t) / harmonic, t) / (place + 1)).astype(np.int64)
        if len(t):
            size[begin[:-1]] += self.n - np.add.reduceat(size, begin[:-1])
        return size

    def sweep(self) -> None:
        mass = self.theta + self.d * self.total
        own = ~self.fixed
        mass[own] = self.d * self.rng.standard_gamma(self.theta / self.d + self.total[own])
        rate = np.maximum(mass[self.of] * self.share, 1e-300)
        t, large = np.ones_like(self.t), int(np.searchsorted(-self.n, -TABLED, side="left"))
        for a in range(0, large, CHUNK // 64):
            rows = slice(a, min(large, a + CHUNK // 64))
            mean, variance = _table_moments(self.n[rows].astype(float), rate[rows], self.d)
            p = np.clip(1 - variance / np.maximum(mean - 1, 1e-12), 1e-6, 1.0)
            trials = np.clip(np.rint((mean - 1) / p), 1, self.n[rows] - 1).astype(np.int64)
            t[rows] = 1 + self.rng.binomial(trials, np.clip((mean - 1) / trials, 0, 1))
        law, a = _table_weights(self.d), large
        while a < len(self.n):  # dishes of about one size, widest first
            wide = int(self.n[a])
            rows = slice(a, min(len(self.n), a + max(1, CHUNK // wide)))
            up = law[self.n[rows], 1:wide + 1] + np.log(rate[rows])[:, None] * np.arange(1, wide + 1)
            up = np.cumsum(np.exp(up - up.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (up < (self.rng.random(len(up)) * up[:, -1])[:, None]).sum(axis=1)
            a = rows.stop
        t = np.minimum(t, self.n)
        self._add(t - self.t)
        self.t = t

    def tables(self) -> np.ndarray:
        """Tables of every dish, in the order given."""
        out = np.empty(len(self.t), dtype=np.int64)
        out[self.order] = self.t
        return out


def _generator(*numbers: int):
    return np.random.Generator(np.random.PCG64([SEED, *numbers]))


def _parent(discount: float, theta: float, n_known: int, total_tables: int):
    def run(key, pdf):
        """A range of the parent's dishes: its customers are the tables of the restaurants below."""
        import pandas as pd
        first = key[0] * PARENT_WORDS
        asked = [unpack_sorted(b) for b in pdf["words"]]
        customers = np.zeros(PARENT_WORDS, dtype=np.int64)
        for words, tables in zip(asked, pdf["tables"], strict=True):
            customers[words - first] += unpack(tables)
        some = np.flatnonzero(customers > 1)
        t = (customers > 0).astype(np.float64)
        if len(some):
            # the total of the other ranges is as told; a range changes it little
            seats = Seating(customers[some], np.zeros(len(some), dtype=np.int64), np.full(len(some), 1 / (n_known + 1)),
                            np.array([total_tables]), np.array([True]), discount, theta, _generator(1, key[0]))
            mean = np.zeros(len(some))
            for sweep in range(BURN_IN + SAMPLES):
                seats.sweep()
                mean += seats.tables() / SAMPLES * (sweep >= BURN_IN)
            t[some] = mean
        mass = customers - discount * t
        out = [(owner, key[0], mass[words - first].astype("<f8").tobytes(), 0.0)
               for owner, words in zip(pdf["owner"], asked, strict=True)]
        out.append((-1, key[0], b"", float(t.sum())))
        return pd.DataFrame(out, columns=["owner", "span", "mass", "n_tables"])
    return run


class _Owner:
    """An owner's restaurants, ready to be swept given the parent."""

    def __init__(self, keys, counts, masses, numbering: Numbering, hot_tables: dict, parent: tuple, discount, theta, rng):
        self.keys, self.counts = keys, counts
        context = keys >> 32
        self.words, self.word = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        mass = np.concatenate([np.frombuffer(m["mass"], dtype="<f8") for m in sorted(masses, key=lambda m: m["span"])])
        base, scale = parent
        share = ((mass + base) / scale)[self.word]
        new = np.append(True, context[1:] != context[:-1]) if len(context) else np.zeros(0, dtype=bool)
        of, heads = np.cumsum(new) - 1, context[new]
        one = (counts > 0).astype(np.float64)
        total = np.bincount(of, weights=one, minlength=len(heads))
        self.customers = np.bincount(of, weights=counts, minlength=len(heads))
        fixed = np.isin(heads, numbering.hot)
        for i in np.flatnonzero(fixed).tolist():
            total[i] = hot_tables[int(heads[i])]
            self.customers[i] = numbering.hot_counts[np.searchsorted(numbering.hot, heads[i])]
        self.many = np.flatnonzero(counts > 1)
        self.t, self.of, self.share, self.d, self.theta = one, of, share, discount, theta
        self.seats = Seating(counts[self.many], of[self.many], share[self.many], total, fixed, discount, theta, rng)

    def sweep(self) -> None:
        self.seats.sweep()
        self.t[self.many] = self.seats.tables()

    def predictive(self) -> np.ndarray:
        rest = (self.theta + self.d * self.seats.total[self.of]) * self.share
        return (np.maximum(self.counts - self.d * self.t, 0) + rest) / (self.theta + self.customers[self.of])


def _sweep(sent, last: bool, number: int):
    """Sweep an owner's restaurants: their tables for the parent, or, at last, the answers to the blocks."""
    def run(batches):
        for batch in batches:
            for owner, keys, counts, blocks, places, masses in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbering, hot_tables, parent, discount, theta = sent.value
                mine = _Owner(unpack_sorted(keys), unpack(counts), masses, numbering, hot_tables, parent, discount, theta,
                              _generator(2, number, owner))
                mean = 0.0
                for sweep in range(BURN_IN + (SAMPLES if last else 0)):
                    mine.sweep()
                    if last and sweep >= BURN_IN:
                        mean = mean + mine.predictive() / SAMPLES
                if last:
                    logs = np.log10(mean)
                    for block, at in zip(blocks, places, strict=True):
                        yield arrow_batch("owner int, block long, logs binary",
                                     [(owner, block, _floats(logs[unpack_sorted(at)]))])
                else:
                    tables = np.bincount(mine.word, weights=mine.t, minlength=len(mine.words)).astype(np.int64)
                    hot = _hot_tables(numbering, mine.keys >> 32, mine.t)
                    yield arrow_batch(STATE, [*_messages(owner, mine.words, tables),
                                         (owner, -1, *[None] * 6, int(tables.sum()), 0, 0, *hot)])
    return run


SCORES = "row long, id long, held boolean, n_tokens long, n_known long, base_score double, score double"


def _score(sent, n_train: int, n_known: int):
    def run(batches):
        for batch in batches:
            out = []
            for rows, ids, held, sizes, stream, answers, logs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = _Pairs(sent.value, sizes, stream, answers)
                log = np.concatenate([_from_floats(a["logs"]) for a in sorted(logs, key=lambda a: a["owner"])])
                count = pairs.count[pairs.stream]
                base = np.log10((count + 1) / (n_train + n_known + 1))
                score = np.zeros(len(pairs.stream))
                score[pairs.scored] = log[pairs.of_token]
                base[~pairs.scored] = 0
                known = (count > 0) & pairs.scored
                sums = [np.add.reduceat(x, pairs.begin).tolist() for x in (known.astype(np.int64), base, score)]
                out += list(zip(rows, ids, (np.frombuffer(held, dtype=np.uint8) > 0).tolist(), (pairs.sizes - 1).tolist(),
                                *sums, strict=True))
            yield arrow_batch(SCORES, out)
    return run


def _discount(once: int, twice: int) -> float:
    """The usual estimate from the numbers of things seen once and twice."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.95)) if once + twice else 0.5


def _tidy(spark) -> None:
    """Let Spark drop the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", theta: float = THETA,
           theta_parent: float = THETA_PARENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a Column over ``doc_id`` that tells the rows that the model does not learn from (a null learns).
    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end per text, which is also the context
    of a text's first word. ``base_score`` is the add-one unigram score, ``score`` the model's log10 probability. Null
    text is empty (one token); rows that share an id are texts of their own; without training rows every token has
    probability one under both; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        id_key(F.col("doc_id")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = stored(rows.mapInArrow(_blocks, BLOCK), "lm-blocks")
    size = blocks.agg(F.sum("tokens").alias("tokens"), F.sum("train_tokens").alias("train"),
                      F.sum("n_words").alias("words")).first()
    tokens, n_train = int(size["tokens"] or 0), int(size["train"] or 0)
    least = spark.sparkContext.defaultParallelism * 2
    owners, word_owners = max(least, -(-tokens // OWNER_TOKENS)), max(least, -(-int(size["words"] or 0) // OWNER_WORDS))

    words = stored(blocks.select("block", "words", "train").mapInArrow(
        _word_slices(word_owners), "owner int, block long, words binary, train binary")
        .groupBy("owner").applyInPandas(_count_words(n_train / (4 * owners)), WORDS), "lm-words")
    totals = words.where("block = -1").select("owner", "n", "known", "once", "twice", "hot", "hot_counts").collect()
    n_known = sum(t["known"] for t in totals)
    numbering = Numbering(totals, owners)
    sent = spark.sparkContext.broadcast(numbering)
    answers = words.where("block >= 0").groupBy("block").agg(
        F.collect_list(F.struct("owner", "ranks", "counts")).alias("answers"))
    state = stored(blocks.select("block", "held", "sizes", "stream").join(answers, "block").mapInArrow(
        _ask(sent), "owner int, block long, keys binary, train binary")
        .groupBy("owner").applyInPandas(_merge(sent), STATE), "lm-restaurants")
    _tidy(spark)

    restaurants = state.where("span = -1").select("owner", "keys", "counts", "blocks", "places")
    counted = state.where("span = -1").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    discount = _discount(int(counted["once"] or 0), int(counted["twice"] or 0))
    parent_discount = _discount(sum(t["once"] for t in totals), sum(t["twice"] for t in totals))
    told, parent_tables, logs = state, n_known, None
    for number in range(rounds):
        customers = int(told.where("span = -1").agg(F.sum("n_tables")).first()[0] or 0)
        hot = told.where("span = -1").select(F.explode(F.arrays_zip("hot", "hot_tables")).alias("h"))
        hot = {r["w"]: int(r["t"]) for r in hot.groupBy(F.col("h.hot").alias("w"))
               .agg(F.sum("h.hot_tables").alias("t")).collect()}  # at most four an owner
        masses = stored(told.where("span >= 0").select("owner", "span", "words", "tables").groupBy("span").applyInPandas(
            _parent(parent_discount, theta_parent, n_known, parent_tables),
            "owner int, span int, mass binary, n_tables double"), "lm-parent")
        parent_tables = float(masses.where("owner = -1").agg(F.sum("n_tables")).first()[0] or 0)
        parent = ((theta_parent + parent_discount * parent_tables) / (n_known + 1), theta_parent + customers)
        given = spark.sparkContext.broadcast((numbering, hot, parent, discount, theta))
        last = number == rounds - 1
        if not last:  # the places of the blocks' questions are read with the answers only
            none = F.array()
            asked = restaurants.select("owner", "keys", "counts", none.cast("array<long>").alias("blocks"),
                                       none.cast("array<binary>").alias("places"))
        else:
            asked = restaurants
        met = asked.join(masses.where("owner >= 0").groupBy("owner").agg(
            F.collect_list(F.struct("span", "mass")).alias("masses")), "owner")
        schema = "owner int, block long, logs binary" if last else STATE
        told = stored(met.mapInArrow(_sweep(given, last, number), schema), "lm-sweep")
        given.destroy()
        _tidy(spark)
    logs = told.groupBy("block").agg(F.collect_list(F.struct("owner", "logs")).alias("logs"))
    scored = (blocks.select("block", "rows", "ids", "held", "sizes", "stream").join(answers, "block").join(logs, "block")
              .select("rows", "ids", "held", "sizes", "stream", "answers", "logs")
              .mapInArrow(_score(sent, n_train, n_known), SCORES))
    with small_batches(spark):
        out = stored(scored.groupBy("row").agg(  # the pieces of a long text
            F.first("id").alias("id"), F.first("held").alias("held"), F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")),
            "lm-scores")
    sent.destroy()
    return out.select(id_back(F.col("id")).alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known",
                      F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, n_tokens, perplexity, base_perplexity) of the rows that ``scores`` returns."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), power("score").alias("perplexity"),
                                          power("base_score").alias("base_perplexity"))
