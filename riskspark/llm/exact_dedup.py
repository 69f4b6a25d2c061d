"""Exact dedup with static binary-fuse filters over an immutable snapshot (operator 7).

The snapshot's SHA-256 digests are cut into buckets by their first digits, one
for each shuffle partition; a bucket's 64-bit keys get a 3-wise binary-fuse filter (Graf and Lemire, 2022)
with 16-bit fingerprints, written once to the shared folder. Distinct digests of an incoming
batch meet their bucket's filter; only positives join the exact buckets, and
rows with equal digests are compared byte for byte with one text of theirs.
Duplicates inside the batch are grouped on their own before that.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.frames import id_back, id_key, pick, stored
from riskspark.llm.textbuf import mix64

#: Rows of one text that meet one copy of it in the byte check.
CHECK_ROWS = 64
FILTER_SCHEMA = "bucket int, seed long, segment long, length long, fingerprints binary"


class FuseFilter:
    """3-wise binary-fuse filter over distinct unsigned 64-bit keys: no false negative, 2**-16 false positives."""

    def __init__(self, seed: int, segment: int, prints: np.ndarray):
        self.seed, self.segment, self.prints = seed, segment, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, length: int):
        h = mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        first = ((h >> np.uint64(32)) * np.uint64(length - 2 * segment)) >> np.uint64(32)
        g = mix64(h)
        mask = np.uint64(segment - 1)
        a = first.astype(np.int64)
        b = ((first + np.uint64(segment)) ^ (g & mask)).astype(np.int64)
        c = ((first + np.uint64(2 * segment)) ^ ((g >> np.uint64(20)) & mask)).astype(np.int64)
        return np.stack([a, b, c]), (h ^ (h >> np.uint64(32))).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel slots that hold a single key, a whole layer at a time, then fill in reverse."""
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        length = -(-int(n * factor + 3 * segment) // segment) * segment
        for seed in range(1, 200):
            if seed % 20 == 0:
                length += length // 4 // segment * segment + segment
            slots, prints = cls._slots(keys, seed, segment, length)
            # a, b and c lie in three different segments, so the slots of one key always differ
            layers, rest = [], np.arange(n)
            count = np.bincount(slots.ravel(), minlength=length)
            xor = np.zeros(length, dtype=np.int64)
            for s in slots:
                np.bitwise_xor.at(xor, s, np.arange(n))
            free = np.flatnonzero(count == 1)
            left = n
            while len(free):
                key = xor[free]
                key, at = np.unique(key, return_index=True)
                layers.append((key, free[at]))
                left -= len(key)
                for s in slots[:, key]:
                    np.subtract.at(count, s, 1)
                    np.bitwise_xor.at(xor, s, key)
                touched = np.unique(slots[:, key].ravel())
                free = touched[count[touched] == 1]
            if left == 0:
                table = np.zeros(length, dtype=np.uint16)
                for key, slot in reversed(layers):
                    a, b, c = slots[:, key]
                    table[slot] = 0
                    table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
                return cls(seed, segment, table)
        raise ValueError("no binary-fuse filter found: are the keys distinct?")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys, self.seed, self.segment, len(self.prints))
        return (self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]]) == prints


def _bucket(spark, digest):
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _keys(hexes) -> np.ndarray:
    return np.array([int(x[8:24], 16) for x in hexes], dtype=np.uint64)


def snapshot_filters(digests: DataFrame) -> DataFrame:
    """One filter row per bucket of a snapshot's distinct ``digest`` column, written to the shared folder."""

    def build(key, pdf):
        import pandas as pd
        f = FuseFilter.build(np.unique(_keys(pdf["digest"])))
        return pd.DataFrame([(key[0], f.seed, f.segment, len(f.prints), f.prints.tobytes())],
                            columns=["bucket", "seed", "segment", "length", "fingerprints"])

    buckets = digests.select("digest").distinct().withColumn("bucket", _bucket(digests.sparkSession, F.col("digest")))
    return stored(buckets.groupBy("bucket").applyInPandas(build, FILTER_SCHEMA), "fuse")


def screen(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """The distinct digests whose bucket's filter answers maybe, with every column."""

    def test(left, right):
        if not len(left) or not len(right):
            return left.iloc[:0]
        f = right.iloc[0]
        table = np.frombuffer(f["fingerprints"], dtype=np.uint16)
        return left[FuseFilter(int(f["seed"]), int(f["segment"]), table).contains(_keys(left["digest"]))]

    batch = digests.withColumn("bucket", _bucket(digests.sparkSession, F.col("digest")))
    return (batch.groupBy("bucket").cogroup(filters.groupBy("bucket"))
            .applyInPandas(test, batch.schema).drop("bucket"))


def groups(docs: DataFrame, in_snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``in_snapshot`` is a boolean column expression over ``doc_id`` that tells
    the rows of the snapshot from the incoming batch. Null text counts as
    empty. The largest doc_id of a group stays (null is smallest); of rows that
    share it, all are kept rows of that id. If two texts ever share a digest, the
    byte check tells them apart and each text forms its own group. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        id_key(F.col("doc_id")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    slim = stored(rows.select("id", "old", F.sha2("text", 256).alias("digest")), "digests")
    sizes = [F.count(F.lit(1)).alias("n"), F.max("id").alias("top")]
    snapshot = slim.where("old").groupBy("digest").agg(*sizes)
    batch = slim.where(~F.col("old")).groupBy("digest").agg(*sizes)
    positives = screen(batch, snapshot_filters(snapshot))
    known = snapshot.join(positives.select("digest", F.col("n").alias("n2"), F.col("top").alias("top2")), "digest")
    # a digest of both sides is known by its snapshot bucket; the rest are groups of one side
    both = known.select("digest", (F.col("n") + F.col("n2")).alias("n"), F.greatest("top", "top2").alias("top"))
    repeats = stored(both.unionByName(snapshot.where("n > 1").join(both, "digest", "left_anti"))
                     .unionByName(batch.where("n > 1").join(both, "digest", "left_anti")), "repeats")
    odd = stored(_differing(rows, repeats), "odd")
    plain = (slim.join(repeats, "digest", "left")
             .select("id", F.coalesce("top", "id").alias("top"), F.coalesce("n", F.lit(1)).alias("n"), "digest"))
    # true digest collisions, as good as never: their rows are grouped by the text itself
    texts = rows.withColumn("digest", F.sha2("text", 256)).join(odd, "digest", "left_semi")
    own = texts.groupBy("digest", "text").agg(*sizes)
    fixed = (texts.join(own, ["digest", "text"])
             .select("id", "top", "n", "digest"))
    return (plain.join(odd, "digest", "left_anti").unionByName(fixed)
            .select(id_back(F.col("id")).alias("doc_id"), id_back(F.col("top")).alias("keep_id"),
                    F.col("n").alias("group_size"), (F.col("id") == F.col("top")).alias("kept"),
                    F.col("digest").alias("text_sha256")))


def _differing(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Digests of which two rows differ in bytes: every row of a group meets the text of the row that stays.

    Rows of large groups are dealt over as many copies of that text as they
    need, so no task gets a whole group.
    """
    shares = F.ceil(F.col("n") / CHECK_ROWS).cast("int")
    # a merge join at every size: the list of repeated digests grows with the corpus and is never broadcast
    member = stored(rows.withColumn("digest", F.sha2("text", 256))
                    .join(repeats.select("digest", "n", "top").hint("merge"), "digest")
                    .select("digest", "id", "text", "n", "top",
                            F.pmod(F.xxhash64("id", "old"), shares).cast("int").alias("share")), "members")
    first = (member.where(F.col("id") == F.col("top"))
             .groupBy("digest", "n").agg(F.min("text").alias("stay"))
             .select("digest", "stay", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share")))
    return (member.join(first, ["digest", "share"]).where(F.col("text") != F.col("stay"))
            .select("digest").distinct())
