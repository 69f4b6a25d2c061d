"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles (operator 9).

1. Document frequencies of words are counted over all documents into a table of
   2**SLOT_BITS hashed slots (its size is fixed, so it can be sent to every task).
   A shingle is five consecutive words; its weight is 1 + ln(count in the text) times the
   mean normalised inverse document frequency of its words.
2. Each text gets ``BANDS * ROWS`` consistent weighted samples (Ioffe, 2010). Two
   texts agree on a sample with probability equal to their weighted Jaccard
   similarity. Texts that agree on all samples of a band share a bucket.
3. Texts connected through buckets form a family. A family meets in one task, or, if it is large, tile by tile, every
   tile holding two bounded parts of it, so that all pairs of a family are looked at and no task gets a whole hot
   family. Pairs whose samples agree often enough are verified by their exact weighted Jaccard similarity, the
   closest first and only while they are in different classes. A tile returns the links that join classes, no pairs.

Copies of a text take part once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.frames import bounded_batches, id_back, id_key, pick, quoted, stored
from riskspark.llm.textbuf import mix64, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SLOT_BITS = 18
STEP_BYTES = 256 << 10
#: Sample agreement below the threshold by more than this (over 3 standard deviations) rules a pair out.
SLACK = 0.17
#: Bounds of one part of a tile, in texts and in bytes, and bytes of tiles that one group of rows holds.
PART_TEXTS, PART_BYTES, GROUP_BYTES = 512, 2 << 20, 2 << 20
#: Rows of a round's stars that a file holds at least, but for a few files a core.
STAR_ROWS = 50_000
_TABLE = 1 << 16
_ODD = mix64(np.arange(1, 600, dtype=np.uint64)) | np.uint64(1)


def _tables():
    rng = np.random.Generator(np.random.PCG64(20100))
    gamma = lambda: -np.log(rng.random(_TABLE)) - np.log(rng.random(_TABLE))
    return gamma().astype(np.float32), np.log(gamma()).astype(np.float32), rng.random(_TABLE).astype(np.float32)


_R, _LOG_C, _BETA = _tables()


def shingles(counts: np.ndarray, hashes: np.ndarray, idf: np.ndarray):
    """(document, shingle hash, weight), sorted by both, of texts given as word hashes.

    A text of fewer than five words, but not none, is one shingle.
    """
    end = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    weight = idf[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.float64)
    at = np.flatnonzero(np.arange(len(hashes)) + SHINGLE <= end[doc]) if len(hashes) else np.zeros(0, dtype=np.int64)
    key = np.zeros(len(at), dtype=np.uint64)
    mean = np.zeros(len(at))
    for i in range(SHINGLE):
        key += hashes[at + i] * _ODD[i]
        mean += weight[at + i]
    key, mean, owner = mix64(key), mean / SHINGLE, doc[at]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        more = [(d, mix64(np.array([np.sum(hashes[end[d] - counts[d]:end[d]] * _ODD[:counts[d]]) + np.uint64(counts[d])],
                                   dtype=np.uint64))[0], weight[end[d] - counts[d]:end[d]].mean()) for d in short.tolist()]
        owner = np.append(owner, [m[0] for m in more])
        key = np.append(key, np.array([m[1] for m in more], dtype=np.uint64))
        mean = np.append(mean, [m[2] for m in more])
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16 if len(counts) < 65536 else np.int64), kind="stable")]
    owner, key, mean = owner[order], key[order], mean[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(key)))
    return owner[first], key[first], (1 + np.log(tf)) * mean[first]


def samples(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents with shingles, their n samples as 64-bit values).

    Sample k of a shingle with weight S: r, c ~ Gamma(2, 1) and beta ~ U(0, 1), drawn by hash of shingle and k;
    t = floor(ln S / r + beta), ln a = ln c - r (t - beta + 1). The shingle with the smallest a and its t are the
    sample.
    """
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(owner)))
    log_s = np.log(weight).astype(np.float32)
    out = np.empty((len(start), n), dtype=np.uint64)
    if not len(start):
        return owner[start], out
    of = np.repeat(np.arange(len(start)), size)
    for k in range(n):
        z = (key ^ _ODD[k]) * _ODD[300 - k]
        r = _R[(z >> np.uint64(48)).astype(np.int64)]
        beta = _BETA[((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        t = np.floor(log_s / r + beta)
        log_a = _LOG_C[((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + np.float32(1))
        low = np.minimum.reduceat(log_a, start)
        at = np.flatnonzero(log_a == low[of])
        at = at[np.append(True, np.diff(of[at]) > 0)]
        out[:, k] = mix64(key[at] + t[at].astype(np.int64).view(np.uint64) * _ODD[301] + np.uint64(k))
    return owner[start], out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(values), bands), dtype=np.uint64)
    for b in range(bands):
        for i in range(rows):
            keys[:, b] += values[:, b * rows + i] * _ODD[310 + i]
        keys[:, b] = mix64(keys[:, b] + _ODD[320 + b])
    return keys.view(np.int64)


def word_idf(rows: DataFrame) -> np.ndarray:
    """1 + ln((N + 1) / (df + 1)) / ln(N + 1) for every slot of word hashes, df over all documents: between 1 for a
    word of every document and 2."""
    part = 1 << 12

    def count(batches):
        import pyarrow as pa
        total, n_docs = np.zeros(1 << SLOT_BITS, dtype=np.int64), 0
        for batch in batches:
            for _, n, hashes in words_of(batch.column(0).cast("binary").to_pylist(), STEP_BYTES):
                slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                pairs = np.sort((np.repeat(np.arange(len(n)), n) << SLOT_BITS) | slot)
                pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
                total += np.bincount(pairs & ((1 << SLOT_BITS) - 1), minlength=1 << SLOT_BITS)
                n_docs += len(n)
        if n_docs:
            table = total.reshape(-1, part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(table)), pa.int32()),
                 pa.array([np.int64(n_docs).tobytes(), *(row.tobytes() for row in table)], pa.binary())],
                names=["block", "counts"])

    def add(key, pdf):
        import pandas as pd
        total = np.sum([np.frombuffer(b, dtype=np.int64) for b in pdf["counts"]], axis=0)
        return pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    schema = "block int, counts binary"
    got = {r["block"]: r["counts"] for r in rows.select("text").mapInArrow(count, schema)
           .groupBy("block").applyInPandas(add, schema).collect()}
    df = np.concatenate([np.frombuffer(got[b], dtype=np.int64) if b in got else np.zeros(part, dtype=np.int64)
                         for b in range((1 << SLOT_BITS) // part)])
    n = int(np.frombuffer(got[-1], dtype=np.int64)[0]) if -1 in got else 0
    return (1 + np.log((n + 1) / (df + 1)) / max(np.log(n + 1), 1e-9)).clip(min=1e-3).astype(np.float32)


def signatures(rows: DataFrame, idf, bands: int, per_band: int) -> DataFrame:
    """(id, tid, agree, keys): 16 bits of every sample, and the band keys; null for a text without words."""

    def run(batches):
        import pyarrow as pa
        table = idf.value
        for batch in batches:
            for first, n, hashes in words_of(batch.column(2).cast("binary").to_pylist(), STEP_BYTES):
                docs, values = samples(*shingles(n, hashes, table), bands * per_band)
                keys = band_keys(values, bands, per_band).tolist()
                short = (values & np.uint64(0xFFFF)).astype("<u2")
                agree, lists = [None] * len(n), [None] * len(n)
                for i, d in enumerate(docs.tolist()):
                    agree[d], lists[d] = short[i].tobytes(), keys[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), batch.column(1).slice(first, len(n)),
                     pa.array(agree, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["id", "tid", "agree", "keys"])

    return rows.select("id", "tid", "text").mapInArrow(run, "id long, tid binary, agree binary, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected component, by alternating large and small stars."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .where("u != v").distinct(), "edges")
    state, tasks = None, edges.sparkSession.sparkContext.defaultParallelism
    files = max(4 * tasks, -(-now.count() // STAR_ROWS))  # rows never grow: a few rows a file would cost a file's price
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = stored(small.coalesce(files), "stars")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted keys, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def links_of(agree: np.ndarray, side: np.ndarray, vectors, threshold: float, slack: float) -> list[tuple[int, int, float]]:
    """Links (x, y, similarity) that join classes among the texts of a tile.

    ``side`` tells the tile's two parts; if there are two, only pairs across them are looked at.
    """
    n = len(agree)
    across = side.min() != side.max()
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right, share = [], [], []
    for x in range(n):
        others = np.flatnonzero(side != side[x]) if across else np.arange(x + 1, n)
        others = others[others > x]
        same = (agree[others] == agree[x]).mean(axis=1)
        near = np.flatnonzero(same >= threshold - slack)
        left.append(np.full(len(near), x))
        right.append(others[near])
        share.append(same[near])
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.argsort(-np.concatenate(share), kind="stable")
    known, out = {}, []
    for x, y in zip(left[order].tolist(), right[order].tolist(), strict=True):
        a, b = root(x), root(y)
        if a == b:
            continue
        for i in (x, y):
            if i not in known:
                known[i] = vectors(i)
        similarity = jaccard(known[x], known[y])
        if similarity >= threshold:
            parent[a] = b
            out.append((x, y, similarity))
    return out


def family_links(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(u, v, similarity): verified links that connect the classes of every family.

    ``members``: tid, family; ``texts``: tid, agree, text, size (bytes).
    """
    sizes = stored(members.join(texts.select("tid", "size"), "tid").groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / PART_TEXTS), F.ceil(F.sum("size") / PART_BYTES)).cast("int").alias("t"),
        F.sum("size").alias("size")), "families")
    total = sizes.agg(F.sum(F.col("size") * F.col("t"))).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP_BYTES))
    dealt = (members.join(sizes.select("family", "t"), "family")
             .withColumn("own", F.pmod(F.xxhash64("tid"), F.col("t")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
             .select("tid", "family", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
             .withColumn("g", F.pmod(F.xxhash64("family", "i", "j"), F.lit(groups))))

    def meet(pdf):
        import pandas as pd
        table, out = idf.value, []
        for _, part in pdf.groupby(["family", "i", "j"], sort=False):
            if len(part) < 2:
                continue
            part = part.sort_values("tid", kind="stable")
            tid, text = part["tid"].tolist(), part["text"].tolist()
            agree = np.stack([np.frombuffer(x, dtype="<u2") for x in part["agree"]])

            def vectors(i, text=text):
                hashes = np.concatenate([h for _, _, h in words_of([text[i]], STEP_BYTES)])
                return shingles(np.array([len(hashes)]), hashes, table)[1:]

            out += [(tid[x], tid[y], s) for x, y, s in
                    links_of(agree, part["own"].to_numpy(), vectors, threshold, SLACK)]
        return pd.DataFrame(out, columns=["u", "v", "similarity"])

    return (dealt.join(texts.select("tid", "agree", "text"), "tid").groupBy("g")
            .applyInPandas(meet, "u binary, v binary, similarity double"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, text_id.

    Classes are the connected components of the links of at least ``threshold`` weighted Jaccard similarity; equal
    texts are one class. class_id is the smallest doc_id of a class, ``kept`` the row of that id. Null and wordless
    texts are in no group: each is its own class. Null ids count as smallest. At similarity 0.8 a pair shares a
    bucket with probability 0.9998 and agrees on enough samples with 0.9995, a closer pair with more. ``text_id`` holds 16 bytes of the text's SHA-256.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        id_key(F.col("doc_id")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tid", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    idf = spark.sparkContext.broadcast(word_idf(rows))
    signed = stored(signatures(rows, idf, bands, per_band), "signatures")
    unique = signed.where(F.col("agree").isNotNull()).groupBy("tid").agg(
        F.first("agree").alias("agree"), F.first("keys").alias("keys"))
    keyed = stored(unique.select("tid", F.explode("keys").alias("key")), "keys")
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("first"))
                    .where("n > 1").select("key", "first"), "buckets")
    families = components(keyed.join(shared, "key").where("tid != first")
                          .select(F.col("tid").alias("u"), F.col("first").alias("v")))
    members = stored(families.select(F.col("node").alias("tid"), F.col("comp").alias("family"))
                     .unionByName(families.select(F.col("comp").alias("tid"), F.col("comp").alias("family")).distinct()),
                     "members")
    # a merge join at every size: the list of texts with a neighbour grows with the corpus and is never broadcast
    # the aggregate comes first: copies collapse where they are read, so a text with many copies is few rows
    texts = stored(rows.groupBy("tid").agg(F.min("text").alias("text")).join(members.select("tid").hint("merge"), "tid")
                   .join(unique.select("tid", "agree"), "tid")
                   .select("tid", "agree", "text", F.octet_length("text").alias("size")), "texts")
    links = stored(family_links(members, texts, idf, threshold), "links")
    idf.destroy()  # all that reads it is written
    joined = components(links.select("u", "v"))
    labels = joined.select(F.col("node").alias("tid"), "comp")
    # a wordless text is alone: its rows get no class key
    placed = stored(signed.select("id", "tid", F.col("agree").isNotNull().alias("worded"))
                    .join(labels, "tid", "left").withColumn("comp", F.coalesce("comp", "tid")), "placed")
    # written first: the join then deals both sides out afresh, and a class with many rows can be split
    sizes = stored(placed.where("worded").groupBy("comp").agg(F.min("id").alias("top"), F.count(F.lit(1)).alias("n")),
                   "sizes")
    return (placed.where("worded").join(sizes, "comp").select("id", "tid", "top", "n")
            .unionByName(placed.where("not worded").select("id", "tid", F.col("id").alias("top"),
                                                           F.lit(1).cast("long").alias("n")))
            .select(id_back(F.col("id")).alias("doc_id"), id_back(F.col("top")).alias("class_id"),
                    F.col("n").alias("class_size"), (F.col("id") == F.col("top")).alias("kept"),
                    F.col("tid").alias("text_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per class stays; wordless rows all stay."""
    found = near_classes(docs, id_col, text_col, **options)
    slim = stored(found, "classes")
    kept = (slim.where("kept").groupBy("doc_id", "text_id", (F.col("class_size") == 1).alias("alone"))
            .agg(F.count(F.lit(1)).alias("n")))
    # rows that share id and class differ in text at most: the smallest text id stays
    first = slim.where("kept and class_size > 1").groupBy("class_id").agg(F.min("text_id").alias("text_id"))
    chosen = (kept.where("not alone").join(first.withColumnRenamed("class_id", "c").withColumnRenamed("text_id", "t"),
                                           F.col("doc_id").eqNullSafe(F.col("c")) & (F.col("text_id") == F.col("t")),
                                           "left_semi")
              .unionByName(kept.where("alone")))
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                       quoted(id_col).cast("long").alias("id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("tid"))
    wanted = chosen.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_t"), "alone", F.col("n").alias("_n"))
    joined = rows.join(wanted, rows["id"].eqNullSafe(wanted["_id"]) & (rows["tid"] == wanted["_t"]))
    single = joined.where("alone or _n = 1").select("row")
    repeated = joined.where("not alone and _n > 1").groupBy("id", "tid").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")
