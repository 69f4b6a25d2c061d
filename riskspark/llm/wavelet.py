"""Token-ID / binary output: one wavelet matrix per shard (operator 1).

Documents are range-partitioned by id and encoded in id order; every run of
about ``shard_tokens`` ids becomes a shard. A shard is one compressed blob: a
header, the document table, and one zstd frame for each bit-plane of the
wavelet matrix (Claude, Navarro and Ordonez, 2015). Bit-planes with popcount
directories answer ``access``, ``rank``, ``select``, ``count`` and
``occurrences`` from the blob alone, touching only its planes.

Shards are written by Spark's Parquet committer, one row each, so a lost
executor leaves no half-written shard, and any storage Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.frames import pick, scratch, small_batches, stored

MAGIC = b"WVMX0001"
SHARD_TOKENS = 2_000_000
#: Ids that a plane is split or merged by at once, so that the places in use stay in the processor's cache.
RUN_IDS = 1 << 15
#: Shard rows: place in the global order, number of documents and of ids, and the blob.
SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, blob binary"


def _zstd():
    import zstandard
    return zstandard


class WaveletMatrix:
    """Succinct sequence of unsigned ids: one bit-plane per bit, highest first."""

    def __init__(self, n: int, levels: int, load):
        self.n, self.levels, self._load = n, levels, load
        self._planes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """(levels, packed bit-planes): each plane is stably split, zeros first, for the next."""
        levels = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes = []
        for level in range(levels):
            bit = (seq >> seq.dtype.type(levels - 1 - level)) & seq.dtype.type(1)
            bit = bit.astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            if level + 1 < levels:
                seq = _split(seq, bit)
        return levels, planes

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(64-bit words, ones before each word, number of zeros)."""
        if level not in self._planes:
            raw = self._load(level)
            words = np.frombuffer(raw + bytes(-len(raw) % 8), dtype="<u8")
            before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
            self._planes[level] = words, before, self.n - int(before[-1])
        return self._planes[level]

    def _rank1(self, level: int, i):
        """Ones among the first i bits of a plane, for a number or an array."""
        words, before, _ = self._plane(level)
        i = np.asarray(i, dtype=np.int64)
        word, off = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << off) - np.uint64(1)
        last = words[np.minimum(word, max(len(words) - 1, 0))] if len(words) else np.zeros_like(off)
        return before[word] + np.where(off > 0, np.bitwise_count(last & mask), 0)

    def _select(self, level: int, bit: int, k):
        """Position of the k-th (from 0) bit of that value in a plane."""
        words, before, _ = self._plane(level)
        k = np.asarray(k, dtype=np.int64)
        count = before if bit else np.arange(len(before), dtype=np.int64) * 64 - before
        word = np.searchsorted(count, k, side="right") - 1
        inside = np.unpackbits(np.ascontiguousarray(words[word]).view(np.uint8).reshape(-1, 8),
                               axis=1, bitorder="little") == bit
        nth = np.cumsum(inside, axis=1)
        return word * 64 + np.argmax(nth == (k - count[word]).reshape(-1, 1) + 1, axis=1)

    def access(self, i: int) -> int:
        """Id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            words, _, zeros = self._plane(level)
            bit = int(words[i >> 6] >> np.uint64(i & 63)) & 1
            ones = int(self._rank1(level, i))
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, symbol: int, end: int) -> tuple[int, int]:
        if symbol < 0 or symbol >> self.levels:
            return 0, 0
        lo, hi = 0, end
        for level in range(self.levels):
            zeros = self._plane(level)[2]
            one_lo, one_hi = (int(x) for x in self._rank1(level, [lo, hi]))
            if symbol >> (self.levels - 1 - level) & 1:
                lo, hi = zeros + one_lo, zeros + one_hi
            else:
                lo, hi = lo - one_lo, hi - one_hi
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of an id among the first i."""
        lo, hi = self._interval(symbol, max(0, min(i, self.n)))
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of an id, ascending."""
        lo, hi = self._interval(symbol, self.n)
        at = np.arange(lo, hi, dtype=np.int64)
        for level in reversed(range(self.levels)):
            if not len(at):
                break
            zeros = self._plane(level)[2]
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - zeros if bit else at)
        return at

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        found = self.occurrences(symbol)
        if not 0 <= k < len(found):
            raise IndexError(k)
        return int(found[k])

    def decode(self) -> np.ndarray:
        """All ids, by merging the planes upwards from the lowest."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        seq = np.zeros(self.n, dtype=kind)
        for level in reversed(range(self.levels)):
            raw = np.frombuffer(self._load(level), dtype=np.uint8)
            bit = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            seq = _merge(seq, bit, kind(1 << (self.levels - 1 - level)))
        return seq


def _split(seq: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Ids without the bit, then those with it, each in order."""
    out, zero, one = np.empty_like(seq), 0, len(bit) - int(np.count_nonzero(bit))
    for lo in range(0, len(seq), RUN_IDS):
        run, part = seq[lo:lo + RUN_IDS], bit[lo:lo + RUN_IDS]
        ones = np.flatnonzero(part)
        zeros = np.flatnonzero(~part)
        out[zero:zero + len(zeros)], out[one:one + len(ones)] = run[zeros], run[ones]
        zero, one = zero + len(zeros), one + len(ones)
    return out


def _merge(seq: np.ndarray, bit: np.ndarray, value) -> np.ndarray:
    """The order before ``_split``, with ``value`` set in the ids that have the bit."""
    out, zero, one = np.empty_like(seq), 0, len(bit) - int(np.count_nonzero(bit))
    for lo in range(0, len(seq), RUN_IDS):
        run, part = out[lo:lo + RUN_IDS], bit[lo:lo + RUN_IDS]
        ones = np.flatnonzero(part)
        zeros = np.flatnonzero(~part)
        run[zeros], run[ones] = seq[zero:zero + len(zeros)], seq[one:one + len(ones)] | value
        zero, one = zero + len(zeros), one + len(ones)
    return out


def pack_shard(doc_ids: list[int | None], n_ids: np.ndarray, ids: np.ndarray) -> bytes:
    """One blob: magic, sizes, (offset, length) of each section, then the sections as zstd frames."""
    z = _zstd().ZstdCompressor(level=1)
    levels, planes = WaveletMatrix.build(ids)
    missing = np.array([d is None for d in doc_ids], dtype=np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    docs = keys.tobytes() + n_ids.astype("<i8").tobytes() + missing.tobytes()
    sections = [z.compress(docs), *(z.compress(p.tobytes()) for p in planes)]
    head = struct.pack("<8sqqq", MAGIC, len(ids), len(doc_ids), levels)
    at = len(head) + 16 * len(sections)
    table = b""
    for s in sections:
        table += struct.pack("<qq", at, len(s))
        at += len(s)
    return head + table + b"".join(sections)


class Shard:
    """Reader of one blob."""

    def __init__(self, blob: bytes):
        magic, n, n_docs, levels = struct.unpack_from("<8sqqq", blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self._blob, self._z = blob, _zstd().ZstdDecompressor()
        self._table = [struct.unpack_from("<qq", blob, 32 + 16 * i) for i in range(levels + 1)]
        docs = self._section(0)
        keys = np.frombuffer(docs, dtype="<i8", count=n_docs)
        self.n_ids = np.frombuffer(docs, dtype="<i8", count=n_docs, offset=8 * n_docs)
        missing = np.frombuffer(docs, dtype=np.uint8, count=n_docs, offset=16 * n_docs)
        self.doc_ids = [None if m else k for k, m in zip(keys.tolist(), missing.tolist(), strict=True)]
        self.matrix = WaveletMatrix(n, levels, lambda level: self._section(level + 1))

    def _section(self, i: int) -> bytes:
        at, size = self._table[i]
        return self._z.decompress(self._blob[at:at + size])


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, append ``end_id`` to each document and write wavelet shards in id order.

    Null text is empty (its document holds the end id alone); null ids come
    first; rows that share an id are ordered by text. An empty table writes no
    shard. ``tokenizer_path`` must be readable on the executors.
    """

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from riskspark.llm.tokens import encoder
        part, seq, code = TaskContext.get().partitionId(), 0, encoder(tokenizer_path).encode
        doc_ids, counts, flat, size = [], [], [], 0

        def flush():
            ids = np.concatenate(flat)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([pack_shard(doc_ids, np.array(counts), ids)], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_pylist()
            for first, n, ids in code(batch.column(1).cast("binary").to_pylist()):
                doc_ids += keys[first:first + len(n)]
                counts += (n + 1).tolist()
                flat.append(np.insert(ids, np.cumsum(n), np.uint32(end_id)))
                size += len(ids) + len(n)
                if size >= shard_tokens:
                    yield flush()
                    doc_ids, counts, flat, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(build, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): ids before each shard, by sums within parts and then over the parts."""
    sizes = shards.select("part", "seq", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    earlier = F.coalesce(F.sum("of_part").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (sizes.withColumn("before", before)
            .join(parts.select("part", earlier.alias("earlier")), "part")
            .select("part", "seq", (F.col("before") + F.col("earlier")).alias("shard_start")))


def document_index(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the blobs: doc_id, start, n_tokens, ids_crc32, part, seq."""

    def decode(batches):
        import pyarrow as pa
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_py())
                ids = shard.matrix.decode()
                ends = np.cumsum(shard.n_ids)
                crcs = [zlib.crc32(ids[e - n:e].astype("<u4").tobytes())
                        for e, n in zip(ends.tolist(), shard.n_ids.tolist(), strict=True)]
                k = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(ends - shard.n_ids, pa.int64()),
                     pa.array(shard.n_ids, pa.int64()), pa.array(crcs, pa.int64()),
                     pa.array(np.full(k, batch.column(0)[row].as_py()), pa.int32()),
                     pa.array(np.full(k, batch.column(1)[row].as_py()), pa.int32())],
                    names=["doc_id", "at", "n_tokens", "ids_crc32", "part", "seq"])

    docs = shards.select("part", "seq", "blob").mapInArrow(
        decode, "doc_id long, at long, n_tokens long, ids_crc32 long, part int, seq int")
    return (docs.join(shard_starts(shards), ["part", "seq"])
            .select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
                    "part", "seq"))


def occurrences(shards: DataFrame, token_ids: list[int]) -> DataFrame:
    """(token_id, position): every place of the given ids in the whole corpus, looked up plane by plane."""

    def find(batches):
        import pyarrow as pa
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_py())
                for token in token_ids:
                    at = shard.matrix.occurrences(token)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), token), pa.int64()), pa.array(at, pa.int64()),
                             pa.array(np.full(len(at), batch.column(0)[row].as_py()), pa.int32()),
                             pa.array(np.full(len(at), batch.column(1)[row].as_py()), pa.int32())],
                            names=["token_id", "at", "part", "seq"])

    found = shards.select("part", "seq", "blob").mapInArrow(find, "token_id long, at long, part int, seq int")
    return (found.join(shard_starts(shards), ["part", "seq"])
            .select("token_id", (F.col("shard_start") + F.col("at")).alias("position")))


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Write the shards to the shared folder and return the document index read back from them."""
    path = scratch(docs.sparkSession, "wavelet")
    write_shards(docs, path, tokenizer_path, end_id, **options)
    return stored(document_index(read_shards(docs.sparkSession, path)), "index")
