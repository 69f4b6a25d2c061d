"""Byte-level BPE encoding with a public tokenizer, one encode per distinct piece of text.

A piece starts at a single space or line feed between two characters that are
not white space. The tokenizer's own pre-tokenisation always breaks there, so the ids of
a text are the ids of its pieces in order; each distinct piece of a step is
encoded once by the ``tokenizers`` library and looked up after that.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from riskspark.llm.textbuf import distinct, groups, ranges, span_hash

STEP_BYTES = 1 << 20
#: Distinct pieces that a worker remembers with their ids; beyond that no more are added.
CACHE_PIECES = 500_000
#: Distinct pieces handed to the tokenizer as one string; it takes more time a byte for longer ones.
JOIN_BYTES = 1 << 10

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space before which a piece may start.
_GAP = np.zeros(256, dtype=bool)
_GAP[[10, 32]] = True
#: Lead bytes of the UTF-8 forms of non-ASCII white space (U+0085, U+00A0, U+1680, U+2000.., U+3000).
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def piece_starts(buf: np.ndarray) -> np.ndarray:
    """Positions at which a new piece may start (the first byte excluded)."""
    at = np.flatnonzero(_GAP[buf])
    at = at[(at >= 3) & (at < len(buf) - 1)]
    bad = _SPACE[buf[at - 1]] | _SPACE[buf[at + 1]] | _LEAD[buf[at + 1]] | _LEAD[buf[at - 2]] | _LEAD[buf[at - 3]]
    return at[~bad]


class _Memory:
    """Pieces seen by a worker: hash, bytes and ids, searched and merged as sorted arrays."""

    def __init__(self, limit: int):
        self.limit = limit
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros((4, 0), dtype=np.int32)  # byte start, bytes, id start, ids
        self.bytes = np.zeros(0, dtype=np.uint8)
        self.ids = np.zeros(0, dtype=np.uint32)

    def find(self, hashes: np.ndarray, joined: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Place of each piece or -1; equal hash, length and bytes make a find."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[place] == hashes) & (self.at[1, place] == lengths))
        n = lengths[hit]
        equal = joined[ranges(starts[hit], n)] == self.bytes[ranges(self.at[0, place[hit]].astype(np.int64), n)]
        wrong = np.add.reduceat(~equal, np.cumsum(n) - n) > 0 if len(hit) else np.zeros(0, dtype=bool)
        out = np.full(len(hashes), -1, dtype=np.int64)
        out[hit[~wrong]] = place[hit[~wrong]]
        return out

    def add(self, hashes, joined, lengths, n_ids, ids):
        if len(self.hashes) + len(hashes) > self.limit or not len(hashes):
            return
        new = np.stack([np.cumsum(lengths) - lengths + len(self.bytes), lengths,
                        np.cumsum(n_ids) - n_ids + len(self.ids), n_ids]).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.at = np.insert(self.hashes, place, hashes[order]), np.insert(self.at, place, new[:, order], axis=1)
        self.bytes, self.ids = np.concatenate([self.bytes, joined]), np.concatenate([self.ids, ids])


@functools.cache
def encoder(tokenizer_path: str) -> PieceEncoder:
    """The worker's encoder for a file: later tasks of a worker find the pieces of earlier ones."""
    return PieceEncoder(tokenizer_path)


class PieceEncoder:
    """Ids of whole texts; ``tokenizer_path`` names a byte-level ``tokenizers`` JSON file.

    The distinct pieces of a step are encoded joined, in strings of some KB:
    a byte-level token has a known number of bytes, so running sums of the
    lengths tell where each piece's ids end.
    """

    def __init__(self, tokenizer_path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for t, i in vocab.items():  # one character stands for one byte, but in added tokens
            self.width[i] = len(t.encode("utf-8")) if t in added else len(t)
        self.memory = _Memory(cache_pieces)
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)

    def _encode_distinct(self, joined: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per piece, all ids) of pieces laid end to end in ``joined``."""
        free = np.isin(starts, piece_starts(joined))  # pieces that the one before doesn't touch
        free[0] = False
        block = starts // JOIN_BYTES
        cut = starts[~free | (np.diff(block, prepend=-1) > 0)]
        raw = joined.tobytes()
        flat = []
        for lo in range(0, len(cut), 4096):
            at = cut[lo:lo + 4097].tolist()
            if lo + 4097 > len(cut):
                at.append(len(raw))
            texts = [raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(at, at[1:], strict=False)]
            flat += [np.array(e.ids, dtype=np.uint32) for e in self.batch(texts, add_special_tokens=False)]
        ids = np.concatenate(flat)
        upto = np.cumsum(self.width[ids])
        ends = np.append(starts[1:], len(raw))
        last = np.searchsorted(upto, ends)
        if upto[-1] != len(raw) or not (upto[last] == ends).all():
            raise ValueError("the tokenizer is not byte-level: its tokens do not add up to the text's bytes")
        return np.diff(last + 1, prepend=0), ids

    def _encode_run(self, run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids) of consecutive texts."""
        sizes = np.array([len(b) for b in run], dtype=np.int64)
        ends_of = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(run), dtype=np.uint8)
        if not len(buf):
            return np.zeros(len(run), dtype=np.int64), np.zeros(0, dtype=np.uint32)
        inner = piece_starts(buf)
        # white space within 3 bytes of a text's first byte is judged by bytes of the text before: leave it uncut
        near = np.searchsorted(ends_of, inner, side="right")
        begin = ends_of[near] - sizes[near]
        inner = inner[(inner - begin >= 3) & (inner + 1 < ends_of[near])]
        starts = np.sort(np.concatenate([inner, (ends_of - sizes)[sizes > 0]]), kind="stable")
        lengths = np.diff(np.append(starts, len(buf)))
        hashes, first, inv = distinct(span_hash(buf, starts, starts + lengths), "quicksort")
        if not ((lengths[first][inv] == lengths).all()
                and (buf[ranges(starts[first][inv], lengths)] == buf).all()):
            # two different pieces share a hash: tell them apart by their bytes
            raw = buf.tobytes()
            seen: dict[bytes, int] = {}
            inv = np.array([seen.setdefault(raw[s:s + n], len(seen))
                            for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
            first = np.unique(inv, return_index=True)[1]
            hashes = np.zeros(len(first), dtype=np.uint64)
        n, flat = self._ids_of(buf, hashes, starts[first], lengths[first])
        per_piece = n[inv]
        out = flat[ranges((np.cumsum(n) - n)[inv], per_piece)]
        done = np.append(0, np.cumsum(per_piece))
        return np.diff(done[np.searchsorted(starts, ends_of)], prepend=0), out

    def _ids_of(self, buf, hashes, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """(ids per distinct piece, all ids): remembered ones looked up, the rest encoded."""
        place = self.memory.find(hashes, buf, starts, lengths)
        new, old = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        new = new[np.argsort(~_GAP[buf[starts[new]]], kind="stable")]
        old_n, old_at = self.memory.at[3, place[old]].astype(np.int64), self.memory.at[2, place[old]].astype(np.int64)
        old_ids = self.memory.ids[ranges(old_at, old_n)]
        n = np.zeros(len(starts), dtype=np.int64)
        n[old] = old_n
        at = np.zeros(len(starts), dtype=np.int64)
        at[old] = np.cumsum(old_n) - old_n
        if not len(new):
            return n, old_ids[ranges(at, n)]
        wide = lengths[new]
        joined = buf[ranges(starts[new], wide)]
        n[new], ids = self._encode_distinct(joined, np.cumsum(wide) - wide)
        at[new] = np.cumsum(n[new]) - n[new] + len(old_ids)
        short = wide <= 64
        keep = np.flatnonzero(short)
        self.memory.add(hashes[new][keep], joined[np.repeat(short, wide)], wide[keep], n[new][keep],
                        ids[np.repeat(short, n[new])])
        return n, np.concatenate([old_ids, ids])[ranges(at, n)]

    def encode(self, texts, step_bytes: int = STEP_BYTES):
        """Yield (first, ids per text, all ids) for runs of consecutive texts."""
        for first, run in groups(texts, step_bytes):
            if len(run) == 1 and len(run[0]) > 2 * step_bytes:
                parts = [self._encode_run([p])[1] for p in self._long(run[0], step_bytes)]
                ids = np.concatenate(parts)
                yield first, np.array([len(ids)], dtype=np.int64), ids
            else:
                yield (first, *self._encode_run(run))

    @staticmethod
    def _long(raw: bytes, step_bytes: int) -> list[bytes]:
        """Cuts of a very long text, each at a place where a piece starts."""
        cuts, at = [], 0
        while len(raw) - at > step_bytes:
            reach, ok = step_bytes, np.zeros(0, dtype=np.int64)
            while not len(ok) and at + reach // 2 < len(raw):
                window = np.frombuffer(raw, dtype=np.uint8, count=min(len(raw) - at, reach), offset=at)
                ok = piece_starts(window)
                reach *= 2
            if not len(ok):
                break
            cuts.append(raw[at:at + int(ok[-1])])
            at += int(ok[-1])
        return [*cuts, raw[at:]]
