"""Line dedup with two Bloom filters, once-seen and twice-seen (operator 8).

Blocks of documents send their distinct line hashes, cut by hash range, to the
owner of the range: eight bytes a line and no text. The owner adds them to two
Bloom filters; a hash that the once-seen filter already holds enters the
twice-seen filter. Hashes in the second are suspected repeats: every true
repeat and few others. Only their lines are then shuffled as text, grouped
exactly, and dropped from all documents but one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.frames import id_back, id_key, pick, range_count, stored
from riskspark.llm.textbuf import LOWER, distinct, groups, span_hash

MIN_POINTS = 40
MIN_DOCS = 5
BLOCK_BYTES = 1 << 20
#: Text whose line hashes one owner gets at most, about.
OWNER_BYTES = 256 << 20
#: Filter bits a hash, and probes: a suspect is wrong about once in 2,000.
BITS, PROBES = 16, 6
_SPACE = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(_SPACE)] = True


class TwiceBloom:
    """Once-seen and twice-seen Bloom filters over 64-bit hashes of about ``expected`` different values."""

    def __init__(self, expected: int):
        self.size = max(64, expected * BITS)
        self.once = np.zeros(self.size, dtype=bool)
        self.twice = np.zeros(self.size, dtype=bool)

    def _probes(self, hashes: np.ndarray):
        a, b = hashes, (hashes >> np.uint64(17)) | np.uint64(1)
        return [((a + np.uint64(i) * b) % np.uint64(self.size)).astype(np.int64) for i in range(PROBES)]

    @staticmethod
    def _holds(table: np.ndarray, probes) -> np.ndarray:
        out = table[probes[0]]
        for p in probes[1:]:
            out = out & table[p]
        return out

    def add(self, hashes: np.ndarray, several: np.ndarray) -> None:
        """Add different hashes; ``several`` tells those that the block holds in more than one document."""
        probes = self._probes(hashes)
        again = several | self._holds(self.once, probes)
        for p in probes:
            self.twice[p[again]] = True
            self.once[p] = True

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        return self._holds(self.twice, self._probes(hashes))


def line_keys(run: list[bytes], min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each, hash of each) over the stripped, lower-cased lines of at least ``min_points`` code points."""
    buf = LOWER[np.frombuffer(b"\n".join(run), dtype=np.uint8)]
    text_end = np.cumsum([len(b) + 1 for b in run])
    ends = np.append(np.flatnonzero(buf == 10), len(buf))
    starts = np.append(0, ends[:-1] + 1)
    solid = np.flatnonzero(~_IS_SPACE[buf])
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = hi > lo
    starts, ends = solid[lo[full]], solid[hi[full] - 1] + 1
    points = np.append(np.int32(0), np.cumsum((buf & 0xC0) != 0x80, dtype=np.int32))
    enough = points[ends] - points[starts] >= min_points
    starts, ends = starts[enough], ends[enough]
    return np.searchsorted(text_end, starts, side="right"), span_hash(buf, starts, ends)


def _key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()  # bytes.lower() changes A-Z only


def _blocks(rows: DataFrame, owners: int, min_points: int) -> DataFrame:
    """(part, seq, owner, hashes, several, docs): distinct line hashes of a block and the documents that hold each."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext
        z, part, seq = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, keys = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in (0, 1))
            for first, texts in groups(batch.column(2).cast("binary").to_pylist(), BLOCK_BYTES):
                doc, hashes = line_keys(texts, min_points)
                if not len(hashes):
                    continue
                found, _, inverse = distinct(hashes)
                pairs = np.unique(np.stack([inverse, doc + first]), axis=1)  # a line counts once in a row
                n_docs = np.bincount(pairs[0], minlength=len(found))
                owner = (found >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
                at = np.searchsorted(owner, np.arange(owners + 1))
                upto = np.append(0, np.cumsum(n_docs))
                have = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(have), pa.int32()), pa.array([seq] * len(have), pa.int32()),
                     pa.array(have, pa.int32()),
                     pa.array([found[at[o]:at[o + 1]].tobytes() for o in have], pa.binary()),
                     pa.array([z.compress(n_docs[at[o]:at[o + 1]].astype("<u4").tobytes()) for o in have], pa.binary()),
                     *[pa.array([z.compress(of[pairs[1][upto[at[o]]:upto[at[o + 1]]]].tobytes()) for o in have],
                                pa.binary()) for of in (ids, keys)]],
                    names=["part", "seq", "owner", "hashes", "n_docs", "docs", "texts"])
                seq += 1

    return rows.select("id", "k", "text").mapInArrow(
        run, "part int, seq int, owner int, hashes binary, n_docs binary, docs binary, texts binary")


def _screen(pdf):
    """Owner of a hash range: fill both filters block by block, then name each block's suspects."""
    import pandas as pd
    import zstandard
    z = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(b, dtype="<u8") for b in pdf["hashes"]]
    bloom = TwiceBloom(sum(map(len, parts)))
    for hashes, n_docs in zip(parts, pdf["n_docs"], strict=True):
        bloom.add(hashes, np.frombuffer(z.decompress(n_docs), dtype="<u4") > 1)
    out = []
    for part, seq, owner, hashes in zip(pdf["part"], pdf["seq"], pdf["owner"], parts, strict=True):
        flags = bloom.suspects(hashes)
        if flags.any():
            out.append((part, seq, owner, np.packbits(flags).tobytes()))
    return pd.DataFrame(out, columns=["part", "seq", "owner", "flags"])


def _suspect_docs(batches):
    """(id, k, hashes): suspected line hashes of each row of a block and hash range."""
    import pyarrow as pa
    import zstandard
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for hashes, n_docs, docs, texts, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes = np.frombuffer(hashes, dtype="<u8")
            n = np.frombuffer(z.decompress(n_docs), dtype="<u4").astype(np.int64)
            ids, keys = (np.frombuffer(z.decompress(b), dtype="<i8") for b in (docs, texts))
            flag = np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=len(hashes)).astype(bool)
            wide = np.repeat(flag, n)
            ids, keys, values = ids[wide], keys[wide], np.repeat(hashes[flag], n[flag])
            order = np.lexsort((values, keys, ids))
            ids, keys, values = ids[order], keys[order], values[order]
            other = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
            new = np.append(True, other | (values[1:] != values[:-1]))  # equal rows send their list once
            at = np.cumsum(new)[np.append(True, other)] - 1
            ids, keys, values = ids[np.append(True, other)], keys[np.append(True, other)], values[new].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(keys), pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()),
                                                                         pa.array(values))],
                names=["id", "k", "hashes"])


def _suspect_lines(min_points: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out_ids, out_ks, out_keys = [], [], []
            ids, ks, texts, wanted = (c.to_pylist() for c in (batch.column(0), batch.column(1),
                                                              batch.column(2).cast("binary"), batch.column(3)))
            for id_, k_, text, hashes in zip(ids, ks, texts, wanted, strict=True):
                want = np.unique(np.concatenate([np.array(h, dtype=np.int64) for h in hashes])).view(np.uint64)
                keys = [k for k in {_key(line) for line in text.split(b"\n")} if len(k) >= min_points]
                if not keys:
                    continue
                _, have = line_keys(keys, 0)
                found = [k for k, hit in zip(keys, np.isin(have, want), strict=True)
                         if hit and len(k.decode()) >= min_points]
                out_ids += [id_] * len(found)
                out_ks += [k_] * len(found)
                out_keys += [k.decode() for k in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_ids, pa.int64()), pa.array(out_ks, pa.int64()), pa.array(out_keys, pa.string())],
                names=["id", "k", "key"])
    return run


def _drop(batches):
    import pyarrow as pa
    for batch in batches:
        out = [[], [], [], [], []]
        for id_, text, drop in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1).cast("binary"),
                                                             batch.column(2))), strict=True):
            if drop:
                gone = {k.encode() for k in drop}
                lines = text.split(b"\n")
                kept = [line for line in lines if _key(line) not in gone]
                n, n_drop, text = len(lines), len(lines) - len(kept), b"\n".join(kept)
            else:
                n, n_drop = text.count(b"\n") + 1, 0
            for col, v in zip(out, (id_, n, n_drop, hashlib.sha256(text).hexdigest(), text.decode()), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
             pa.array(out[3], pa.string()), pa.array(out[4], pa.string())],
            names=["id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, kept_text.

    A line's key is the line stripped of white space and with A-Z lower-cased. Keys of ``min_points`` code points
    or more that ``min_docs`` documents or more hold lose all their lines but those in the largest doc_id. Null
    text is one empty line. A document is a doc_id: rows that share one (null ids share the smallest) count once. An
    empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        id_key(F.col("doc_id")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows that share an id (all those without one) are told apart by their text: equal rows have equal answers
    rows = rows.select("id", F.xxhash64("text").alias("k"), "text")
    owners = range_count(rows, "text", OWNER_BYTES)
    blocks = stored(_blocks(rows, owners, min_points), "lines")
    flags = (blocks.select("part", "seq", "owner", "hashes", "n_docs").groupBy("owner")
             .applyInPandas(_screen, "part int, seq int, owner int, flags binary"))
    suspects = (blocks.join(flags, ["part", "seq", "owner"]).select("hashes", "n_docs", "docs", "texts", "flags")
                .mapInArrow(_suspect_docs, "id long, k long, hashes array<long>")
                .groupBy("id", "k").agg(F.collect_set("hashes").alias("wanted")))
    lines = stored(rows.join(suspects, ["id", "k"]).select("id", "k", "text", "wanted")
                   .mapInArrow(_suspect_lines(min_points), "id long, k long, key string"), "suspects")
    # written first: the join below then deals both sides out afresh, and a key that many documents hold can be split
    common = stored(lines.select("id", "key").distinct().groupBy("key")
                    .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where(F.col("n") >= min_docs), "common")
    drops = (lines.join(common, "key").where(F.col("id") != F.col("top"))
             .groupBy("id", "k").agg(F.collect_set("key").alias("gone")))
    kept = rows.join(drops, ["id", "k"], "left").select("id", "text", "gone").mapInArrow(
        _drop, "id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    return kept.select(id_back(F.col("id")).alias("doc_id"), "n_lines", "n_dropped", "kept_sha256", "kept_text")
