"""Benchmark decontamination over a distributed positional inverted index (operator 2).

``build_index`` writes one row per segment (a few MB of consecutive documents):
the sorted hashes of its terms, their posting counts and delta-coded positions,
and the table of its documents. Segments are built where the documents are
read, without a shuffle. ``find_matches`` takes benchmark items as the stated
query set, in blocks of bounded size, and meets every segment: the posting
lists of a window's terms are intersected after subtracting each term's offset,
from the locally rarest term on; with ``slop`` > 0 a term may stand that many
words off its place (proximity matches).

A term is a 64-bit hash of its word; a window matches when all its hashes stand
at consecutive positions of one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.frames import arrow_batch, pick, scratch, small_batches, stored
from riskspark.llm.textbuf import distinct, ranges, words_of

WINDOW = 10
SEGMENT_BYTES = 3 << 20
BLOCK_WINDOWS = 50_000
#: Free positions between documents of a segment, so that no window spans two of them.
GAP = 64
INDEX_SCHEMA = ("part int, seq int, doc_ids array<long>, n_words array<long>, terms binary, counts binary, "
                "deltas binary")
MATCH_SCHEMA = "part int, seq int, ord int, doc_id long, n_words long, item string, item_no long, first long, last long"


def _postings(counts: np.ndarray, hashes: np.ndarray):
    """(sorted terms, postings per term, positions grouped by term and ascending)."""
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    position = np.arange(len(hashes), dtype=np.int64) + GAP * (doc + 1)
    terms, _, term = distinct(hashes)
    order = np.argsort(term, kind="stable")
    return terms, np.bincount(term, minlength=len(terms)), position[order]


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write the positional index of whole texts; a null text has no words, a null id stays null."""

    def build(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext
        z, part, seq = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            for first, n, hashes in words_of(batch.column(1).cast("binary").to_pylist(), segment_bytes):
                terms, counts, at = _postings(n, hashes)
                deltas = np.diff(at, prepend=0)
                begin = np.cumsum(counts) - counts
                deltas[begin] = at[begin]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                     pa.array([keys.slice(first, len(n)).to_pylist()], pa.list_(pa.int64())),
                     pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([terms.tobytes()], pa.binary()),
                     pa.array([z.compress(counts.astype("<u4").tobytes())], pa.binary()),
                     pa.array([z.compress(deltas.astype("<u4").tobytes())], pa.binary())],
                    names=["part", "seq", "doc_ids", "n_words", "terms", "counts", "deltas"])
                seq += 1

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with small_batches(docs.sparkSession):
        rows.mapInArrow(build, INDEX_SCHEMA).write.option("compression", "none").parquet(path)


QUERY_SCHEMA = "items array<string>, item_nos array<long>, item_of binary, offsets binary, lengths binary, hashes binary"


def query_blocks(items: DataFrame, window: int, block_windows: int) -> DataFrame:
    """The windows of the items (item, text) as rows of at most ``block_windows`` windows, built where items are read.

    An item with more windows goes on in the next row. ``item_nos`` tells the items apart.
    """

    def build(batches):
        from pyspark import TaskContext
        part, no = TaskContext.get().partitionId(), 0
        names, numbers, rows = [], [], []

        def flush():
            nonlocal names, numbers, rows
            wide = np.zeros((len(rows), window), dtype="<u8")
            for i, (_, _, h) in enumerate(rows):
                wide[i, :len(h)] = h
            out = arrow_batch(QUERY_SCHEMA, [(
                names, numbers, np.array([r[0] for r in rows], dtype="<i8").tobytes(),
                np.array([r[1] for r in rows], dtype="<i8").tobytes(),
                np.array([len(r[2]) for r in rows], dtype="<i8").tobytes(), wide.tobytes())])
            names, numbers, rows = [], [], []
            return out

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist(), strict=True):
                hashes = np.concatenate([h for _, _, h in words_of([text])])
                size, no = min(window, len(hashes)), no + 1
                for at in range(len(hashes) - size + 1 if size else 0):
                    if len(rows) == block_windows:
                        yield flush()
                    if not numbers or numbers[-1] != (part << 32) + no:
                        names.append(item)
                        numbers.append((part << 32) + no)
                    rows.append((len(names) - 1, at, hashes[at:at + size]))
        if rows:
            yield flush()

    return items.mapInArrow(build, QUERY_SCHEMA)


class Queries:
    """A block of benchmark windows: term hashes, lengths and the item and offset of each."""

    def __init__(self, window: int, items=(), item_nos=(), item_of=b"", offsets=b"", lengths=b"", hashes=b""):
        self.items, self.item_nos = list(items), np.array(item_nos, dtype=np.int64)
        self.item_of, self.offsets = np.frombuffer(item_of, dtype="<i8"), np.frombuffer(offsets, dtype="<i8")
        self.hashes = np.frombuffer(hashes, dtype="<u8").reshape(-1, window)
        self.used = np.arange(window) < np.frombuffer(lengths, dtype="<i8")[:, None]


def intersect(terms: np.ndarray, counts: np.ndarray, at: np.ndarray, hashes: np.ndarray, used: np.ndarray,
              slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of every match in one segment, rarest terms first."""
    none = np.zeros(0, dtype=np.int64)
    if not len(terms):
        return none, none
    rank = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    n = np.where(terms[rank] == hashes, counts[rank], 0)
    n = np.where(used, n, np.iinfo(np.int64).max)
    alive = np.flatnonzero(n.min(axis=1) > 0)
    if not len(alive):
        return none, none
    order = np.argsort(n[alive], axis=1, kind="stable")
    begin = np.cumsum(counts) - counts
    key = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | at
    term = rank[alive, order[:, 0]]
    window = np.repeat(alive, counts[term])
    start = at[ranges(begin[term], counts[term])] - np.repeat(order[:, 0], counts[term])
    place = np.repeat(np.arange(len(alive)), counts[term])
    for step in range(1, hashes.shape[1]):
        offset = order[place, step]
        live = used[window, offset]
        want = (rank[window, offset].astype(np.int64) << 32) | np.maximum(start + offset, 0)
        low = np.searchsorted(key, want - slop, side="left")
        found = key[np.minimum(low, len(key) - 1)]
        keep = ~live | ((low < len(key)) & (found <= want + slop))
        window, start, place = window[keep], start[keep], place[keep]
        if not len(window):
            break
    return window, start


def find_matches(index: DataFrame, queries: Queries, slop: int = 0, with_docs: bool = True) -> DataFrame:
    """Runs of matching windows for one block of queries: words [first, last) of a document match an item.

    Consecutive windows of an item that match at consecutive places form one
    row. With ``with_docs`` every document also has one row without an item.
    """
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        import pyarrow as pa
        import zstandard
        z = zstandard.ZstdDecompressor()
        asked = sent.value
        items, item_of, offset_of, hashes, used = asked.items, asked.item_of, asked.offsets, asked.hashes, asked.used
        size_of = used.sum(axis=1) if len(used) else np.zeros(0, dtype=np.int64)
        for batch in batches:
            part, seq, ids, words, terms, counts, deltas = (batch.column(c) for c in range(7))
            for row in range(batch.num_rows):
                n_words = np.array(words[row].as_py(), dtype=np.int64)
                doc_ids = ids[row].as_py()
                term = np.frombuffer(terms[row].as_py(), dtype=np.uint64)
                count = np.frombuffer(z.decompress(counts[row].as_py()), dtype="<u4").astype(np.int64)
                at = np.frombuffer(z.decompress(deltas[row].as_py()), dtype="<u4").astype(np.int64)
                if len(at):
                    at = np.cumsum(at)
                    begin = np.cumsum(count) - count
                    before = np.append(0, at[begin[1:] - 1])
                    at = at - np.repeat(before, count)
                w, start = intersect(term, count, at, hashes, used, slop)
                base = np.cumsum(n_words) - n_words + GAP * (np.arange(len(n_words)) + 1)
                doc = np.searchsorted(base, start, side="right") - 1
                first = start - base[doc] if len(w) else start
                last = first + size_of[w]
                lead = first - offset_of[w]  # equal along a run of windows of one item
                order = np.lexsort((first, lead, item_of[w], doc))
                doc, w, first, last, lead = doc[order], w[order], first[order], last[order], lead[order]
                item = item_of[w]
                new = np.ones(len(w), dtype=bool)
                new[1:] = ((np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(lead) != 0) | (np.diff(first) > 1))
                head = np.flatnonzero(new)
                end = last[np.append(head[1:], len(w)) - 1] if len(head) else head
                rows = [(d, items[i], int(asked.item_nos[i]), f, e) for d, i, f, e in
                        zip(doc[head].tolist(), item[head].tolist(), first[head].tolist(), end.tolist(), strict=True)]
                if with_docs:
                    rows += [(d, None, None, None, None) for d in range(len(n_words))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                k = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part[row].as_py()), pa.int32()),
                     pa.array(np.full(k, seq[row].as_py()), pa.int32()), pa.array(cols[0], pa.int32()),
                     pa.array([doc_ids[d] for d in cols[0]], pa.int64()),
                     pa.array([int(n_words[d]) for d in cols[0]], pa.int64()), pa.array(cols[1], pa.string()),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    names=["part", "seq", "ord", "doc_id", "n_words", "item", "item_no", "first", "last"])

    found = stored(index.mapInArrow(run, MATCH_SCHEMA), "matches")
    sent.destroy()
    return found


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0,
            block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Index the documents and look up every benchmark item, block of windows after block.

    The driver holds one block at a time, whatever the size of the benchmark; every block's matches are written before
    the next is sent. Null texts have no words; rows that share an id are separate; empty tables match nothing.
    """
    spark = docs.sparkSession
    path = scratch(spark, "postings")
    build_index(docs, path, id_col, text_col)
    index = spark.read.schema(INDEX_SCHEMA).parquet(path)
    items = pick(benchmark, item=item_col, text=item_text_col).select(F.col("item").cast("string"),
                                                                      F.col("text").cast("string"))
    blocks = stored(query_blocks(items, window, block_windows), "windows")
    out = None
    for row in blocks.toLocalIterator():
        part = find_matches(index, Queries(window, **row.asDict()), slop, out is None)
        out = part if out is None else out.unionByName(part)
    return find_matches(index, Queries(window), slop) if out is None else out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: n_words, words hit, matching items and whether any word is hit.

    A word counts once however many windows cover it. Items that share an
    item_id are one item; an item without an id marks its words and counts,
    with an empty name. Rows that share a doc_id are separate documents.
    """
    found = matches(docs, benchmark, **options)
    doc = Window.partitionBy("part", "seq", "ord")
    reach = F.max("last").over(doc.orderBy(F.col("first").asc_nulls_first(), "last")
                               .rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.coalesce(reach, F.lit(0))))
    names = F.array_sort(F.collect_set(F.when(F.col("first").isNotNull(), F.coalesce("item", F.lit("")))))
    return (found.withColumn("fresh", F.when(F.col("first").isNotNull(), fresh))
            .groupBy("part", "seq", "ord")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                 F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"), names.alias("items"))
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"), "items"))
