"""Vectorised byte-level helpers that the operators of this subpackage share inside tasks.

Texts are handled as UTF-8 bytes in NumPy arrays, a bounded number of bytes at
a time, so a worker's memory does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Text bytes that one vectorised step handles.
STEP_BYTES = 512 << 10

_WORD = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] on lower-cased bytes
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Powers of the hash base and of its inverse that a worker keeps; higher ones are products of two.
_TABLE = 1 << 15


def _powers(base: int) -> np.ndarray:
    out = np.full(_TABLE, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_P), _powers(_P_INV)


def _high(base: int, n: int) -> np.ndarray:
    """Powers 0, _TABLE, 2 * _TABLE ... of the base, for exponents below ``n``."""
    out = np.full(n // _TABLE + 1, pow(base, _TABLE, 1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes, in one pass over ``buf``.

    A prefix sum of byte values times powers of an odd base; what a worker keeps between calls is of fixed size.
    """
    acc = np.empty(len(buf) + 1, dtype=np.uint64)
    acc[0] = 0
    for at, high in zip(range(0, len(buf), _TABLE), _high(_P, len(buf)), strict=False):
        part = acc[at + 1:at + 1 + _TABLE]
        np.add(buf[at:at + _TABLE], np.uint64(1), out=part)
        part *= _UP[:len(part)]
        part *= high
    np.cumsum(acc, out=acc)
    h = acc[ends]
    h -= acc[starts]
    h *= _DOWN[starts % _TABLE]
    if len(buf) > _TABLE:
        h *= _high(_P_INV, len(buf))[starts // _TABLE]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a lower-cased byte array."""
    edge = np.empty(len(buf) + 2, dtype=np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = _WORD[buf]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def groups(texts, step_bytes: int = STEP_BYTES):
    """Yield (first, bytes list) runs of consecutive texts of about ``step_bytes`` together; null is empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t)
        if run and size + len(b) > step_bytes:
            yield first, run
            first, run, size = i, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def pieces(raw: bytes, step_bytes: int, stop) -> list[bytes]:
    """Cut a long text after a byte for which ``stop`` holds, so that no step exceeds ``step_bytes`` by much."""
    out, at = [], 0
    while len(raw) - at > step_bytes:
        end = at + step_bytes
        while end < len(raw) and not stop(raw[end - 1]):
            end += 1
        out.append(raw[at:end])
        at = end
    out.append(raw[at:])
    return out


def _not_word(byte: int) -> bool:
    return not _WORD[LOWER[byte]]


def words_of(texts, step_bytes: int = STEP_BYTES):
    """Yield (first, n_words per text, word hashes) for runs of consecutive texts.

    Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
    A text longer than a step is hashed in several cuts that never split a word.
    """
    for first, run in groups(texts, step_bytes):
        if len(run) == 1 and len(run[0]) > 2 * step_bytes:
            parts = [_hash_words([p])[1] for p in pieces(run[0], step_bytes, _not_word)]
            hashes = np.concatenate(parts)
            yield first, np.array([len(hashes)], dtype=np.int64), hashes
        else:
            yield (first, *_hash_words(run))


def _hash_words(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = LOWER[np.frombuffer(b"\n".join(run), dtype=np.uint8)]
    starts, ends = word_spans(buf)
    bounds = np.cumsum([len(b) + 1 for b in run])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return counts.astype(np.int64), span_hash(buf, starts, ends)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def distinct(values: np.ndarray, kind: str = "stable") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, index of one occurrence of each, inverse); faster than ``np.unique`` on 64-bit hashes."""
    order = np.argsort(values, kind=kind)
    ranked = values[order]
    new = np.empty(len(values), dtype=bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    inverse = np.empty(len(values), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse
