"""Substring dedup by content-defined chunking with a gear rolling hash (operator 5).

A gear hash over the last 16 bytes places chunk ends, so chunks of a repeated
passage start and end alike wherever it stands, whatever was inserted before.
Chunks are deduplicated by a 128-bit digest:

1. each block (a few MB of documents, where they are read) writes its chunk
   table and, per digest range, its distinct digests with counts and smallest
   document;
2. the owner of a digest range adds the counts of all blocks and answers each
   block with the digests that repeat and the smallest document holding them;
   (a passage that stands again in its own document is found within the block);
3. each block merges consecutive repeated chunks into runs. A run of at least
   ``min_words`` words, or as long as that many average words, is a repeated
   passage. It stays in the smallest document that holds it and is dropped from
   the others.

Words begin after ASCII white space. Text without it (Chinese, Japanese, Thai,
lists joined by commas) has hardly any word starts, so a run also counts by its
code points other than ASCII white space: ``WORD_CHARS`` of them stand for a
word. Chunks end between code points, so that no cut leaves half of one.

A block sends a digest once however often it occurs there, so a passage that a
third of all documents share is a handful of rows. No text is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.frames import bounded_batches, id_back, id_key, pick, range_count, stored
from riskspark.llm.textbuf import groups, mix64

#: Mean distance of chunk ends is 2**MASK_BITS bytes beyond the smallest chunk.
MASK_BITS = 4
MIN_CHUNK, MAX_CHUNK = 8, 512
#: Words that a run of repeated chunks holds to count as a repeated passage. The chunks inside a passage lack
#: its edges (some 30 bytes on either side), so this is well below the passages' 50 words.
MIN_WORDS = 20
#: Code points that stand for a word in a run with too few word starts (words of the given tables hold 5.2, and a space).
WORD_CHARS = 6
BLOCK_BYTES = 2 << 20
#: Text whose chunk digests one owner gets at most, about.
OWNER_BYTES = 64 << 20
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MASK = np.uint32(((1 << MASK_BITS) - 1) << (16 - MASK_BITS))
BLOCK_SCHEMA = "part int, seq int, doc_ids binary, text_keys binary, chunks binary, sizes binary, words binary, chars binary, place binary"
ASK_SCHEMA = "part int, seq int, owner int, base long, digests binary, counts binary, docs binary"
ANSWER_SCHEMA = "part int, seq int, at binary, docs binary"
OUT_SCHEMA = ("doc_id long, text_key long, n_chunks long, n_repeated long, repeated_words long, longest_run_words long, "
              "dropped_words long, keep_ids array<long>, repeated_spans array<array<long>>, "
              "dropped_spans array<array<long>>, inner_words long, inner_spans array<array<long>>")


def gear(buf: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: sum of G[b] << age over the last 16 bytes, by doubling."""
    h = _GEAR[buf]
    for reach in (1, 2, 4, 8):
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))  # the right side is whole before it is stored
    return h


def chunk_ends(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks per text, chunk ends in the joined bytes); every text ends a chunk, an empty text has none."""
    raw = b"".join(run)
    buf = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.array([len(b) for b in run], dtype=np.int64)
    ends_of = np.cumsum(sizes)
    cand = np.flatnonzero((gear(buf) & _MASK) == 0) + 1 if len(buf) else np.zeros(0, dtype=np.int64)
    text = np.searchsorted(ends_of, cand, side="left")
    cand = cand[cand - (ends_of - sizes)[text] >= 16]  # else the hash holds bytes of the text before
    for _ in range(3):  # on to the start of a code point; a text never starts inside one
        cand = cand + _inside(buf, cand)
    out, per_text = [], []

    def furthest(at: int) -> int:
        """The last start of a code point that a chunk from ``at`` can reach."""
        at += MAX_CHUNK
        return at - next((k for k in range(4) if raw[at - k] & 0xC0 != 0x80), 0)

    cut = np.searchsorted(cand, ends_of).tolist()
    cand = cand.tolist()
    i, begin = 0, 0
    for end, stop in zip(ends_of.tolist(), cut, strict=True):
        have, at = len(out), begin
        while i < stop:
            c = cand[i]
            i += 1
            if c - at < MIN_CHUNK or c == end:
                continue
            while c - at > MAX_CHUNK:
                at = furthest(at)
                out.append(at)
            out.append(c)
            at = c
        while end - at > MAX_CHUNK:
            at = furthest(at)
            out.append(at)
        if end > at:
            out.append(end)
        i, begin = max(i, stop), end
        per_text.append(len(out) - have)
    return np.array(per_text, dtype=np.int64), np.array(out, dtype=np.int64)


def _inside(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a byte goes on a code point that began before it; false past the end."""
    return (at < len(buf)) & (buf[np.minimum(at, len(buf) - 1)] & 0xC0 == 0x80) if len(at) else np.zeros(0, dtype=bool)


def _space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def _word_starts(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that begin in each chunk."""
    space = _space(buf)
    begin = ~space
    begin[1:] &= space[:-1]
    upto = np.append(0, np.cumsum(begin))
    return np.diff(upto[ends], prepend=0)


def _chars(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in each chunk, without ASCII white space."""
    upto = np.append(0, np.cumsum(((buf & 0xC0) != 0x80) & ~_space(buf)))
    return np.diff(upto[ends], prepend=0)


def _digests(raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """xxh3-128 of each chunk as two unsigned 64-bit columns."""
    from xxhash import xxh3_128_digest as digest
    return np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(starts, ends, strict=True)]),
                         dtype="<u8").reshape(-1, 2)


def _distinct(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(one row of each distinct digest in order, inverse, their number)."""
    order = np.lexsort((d[:, 1], d[:, 0]))
    ranked = d[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    inverse = np.empty(len(d), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse, int(new.sum())


def _tables(rows: DataFrame, owners: int) -> DataFrame:
    """Chunk table and questions of each block in one pass: ``kind`` 0 and 1."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext
        z, part, seq = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        pack = lambda a: z.compress(np.ascontiguousarray(a).tobytes())
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            keys = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for first, texts in groups(batch.column(2).cast("binary").to_pylist(), BLOCK_BYTES):
                doc = slice(first, first + len(texts))
                per_text, ends = chunk_ends(texts)
                buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
                starts = np.append(0, ends)[:-1]
                found, place, _ = _distinct(_digests(buf.tobytes(), starts.tolist(), ends.tolist()))
                of = np.repeat(np.arange(len(texts)), per_text)
                low, high = np.full(len(found), len(texts)), np.full(len(found), -1)
                np.minimum.at(low, place, of)
                np.maximum.at(high, place, of)
                counts = 1 + (high > low)  # documents of the block that hold it: one or more
                holder = np.full(len(found), np.iinfo(np.int64).max)
                np.minimum.at(holder, place, ids[doc][of])
                owner = (found[:, 0] >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
                base = np.searchsorted(owner, np.arange(owners + 1))
                have = np.flatnonzero(np.diff(base))
                n = len(have)
                yield pa.RecordBatch.from_pylist(
                    [{"kind": 0, "part": part, "seq": seq, "owner": 0, "base": 0, "a": pack(ids[doc]),
                      "b": pack(keys[doc]), "c": pack(per_text), "d": pack((ends - starts).astype("<u2")),
                      "e": pack(_word_starts(buf, ends).astype("<u2")), "f": pack(_chars(buf, ends).astype("<u2")),
                      "g": pack(place.astype("<u4"))}]
                    + [{"kind": 1, "part": part, "seq": seq, "owner": int(o), "base": int(base[o]),
                        "a": found[base[o]:base[o + 1]].tobytes(),
                        "b": pack(counts[base[o]:base[o + 1]].astype(np.uint8)),
                        "c": pack(holder[base[o]:base[o + 1]]), "d": None, "e": None, "f": None,
                        "g": None}
                       for o in have.tolist()],
                    schema=pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()),
                                      ("owner", pa.int32()), ("base", pa.int64()),
                                      *[(c, pa.binary()) for c in "abcdefg"]]))
                seq += 1

    return rows.mapInArrow(run, "kind int, part int, seq int, owner int, base long, a binary, b binary, c binary, "
                                "d binary, e binary, f binary, g binary")


def _answer(pdf):
    """Owner of a digest range: which of each block's digests repeat, and the smallest document of each."""
    import pandas as pd
    import zstandard
    z = zstandard.ZstdDecompressor()
    blobs = pdf["digests"].tolist()
    n = np.array([len(b) // 16 for b in blobs], dtype=np.int64)
    d = np.frombuffer(b"".join(blobs), dtype="<u8").reshape(-1, 2)
    count = np.frombuffer(b"".join(z.decompress(b) for b in pdf["counts"]), dtype=np.uint8)
    doc = np.frombuffer(b"".join(z.decompress(b) for b in pdf["docs"]), dtype="<i8")
    found, place, _ = _distinct(d)
    low = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(low, place, doc)
    repeated = (np.bincount(place, weights=count, minlength=len(found)) >= 2)[place]
    out, end = [], np.cumsum(n)
    for part, seq, base, lo, hi in zip(pdf["part"], pdf["seq"], pdf["base"], end - n, end, strict=True):
        at = np.flatnonzero(repeated[lo:hi])
        if len(at):
            out.append((part, seq, (at + base).astype("<u4").tobytes(), low[place[lo:hi][at]].astype("<i8").tobytes()))
    return pd.DataFrame(out, columns=["part", "seq", "at", "docs"])


def _runs(flag: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of set flags, none across two documents."""
    if not len(flag):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    prev = np.append(False, flag[:-1] & (doc[1:] == doc[:-1]))
    follow = np.append(flag[1:] & (doc[1:] == doc[:-1]), False)
    return np.flatnonzero(flag & ~prev), np.flatnonzero(flag & ~follow) + 1


def _again(place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of chunks that follow one another as they did before in the same document."""
    key = doc * (int(place.max()) + 1 if len(place) else 1) + place
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before = np.full(len(place), -2)
    before[order[1:][same]] = order[:-1][same]
    again = before >= 0
    linked = again[1:] & again[:-1] & (before[1:] == before[:-1] + 1) & (doc[1:] == doc[:-1])
    return np.flatnonzero(again & ~np.append(False, linked)[:len(again)]), np.flatnonzero(
        again & ~np.append(linked, False)[:len(again)]) + 1


def _decide(min_words: int):
    def decide(left, right):
        import pandas as pd
        import zstandard
        z = zstandard.ZstdDecompressor()
        out = []
        for row in left.itertuples():
            ids, keys, per_text = (np.frombuffer(z.decompress(b), dtype="<i8")
                                   for b in (row.doc_ids, row.text_keys, row.chunks))
            sizes, words, chars = (np.frombuffer(z.decompress(b), dtype="<u2").astype(np.int64)
                                   for b in (row.sizes, row.words, row.chars))
            place = np.frombuffer(z.decompress(row.place), dtype="<u4").astype(np.int64)
            holder = np.full(int(place.max()) + 1 if len(place) else 0, np.iinfo(np.int64).min)
            repeat = np.zeros(len(holder), dtype=bool)
            for at, docs in zip(right["at"], right["docs"], strict=True):
                at = np.frombuffer(at, dtype="<u4")
                repeat[at], holder[at] = True, np.frombuffer(docs, dtype="<i8")
            doc = np.repeat(np.arange(len(ids)), per_text)
            ends = np.cumsum(sizes)
            text_end = np.append(0, np.cumsum(np.bincount(doc, weights=sizes, minlength=len(ids)))).astype(np.int64)
            flag = repeat[place]
            drop = flag & (holder[place] != ids[doc])
            total, length = np.append(0, np.cumsum(words)), np.append(0, np.cumsum(chars))
            spans = {}
            for name, (first, last) in (("all", _runs(flag, doc)), ("drop", _runs(drop, doc)), ("inner", _again(place, doc))):
                size, by_length = total[last] - total[first], (length[last] - length[first]) // WORD_CHARS
                size = np.where(size < min_words, np.maximum(size, by_length), size)
                long = size >= min_words
                spans[name] = (doc[first[long]], first[long], last[long], size[long])
            n_rep = np.bincount(doc, weights=flag, minlength=len(ids)).astype(np.int64)
            res = [[int(k), int(t), int(c), int(r), 0, 0, 0, [], [], [], 0, []] for k, t, c, r in
                   zip(ids, keys, per_text, n_rep, strict=True)]
            for d, f, e, w in zip(*(a.tolist() for a in spans["all"]), strict=True):
                res[d][4] += w
                res[d][5] = max(res[d][5], w)
                res[d][8].append([int(ends[f] - sizes[f] - text_end[d]), int(ends[e - 1] - text_end[d])])
            for d, f, e, w in zip(*(a.tolist() for a in spans["drop"]), strict=True):
                res[d][6] += w
                res[d][7] += holder[place[f:e]].tolist()
                res[d][9].append([int(ends[f] - sizes[f] - text_end[d]), int(ends[e - 1] - text_end[d])])
            for d, f, e, w in zip(*(a.tolist() for a in spans["inner"]), strict=True):
                res[d][10] += w
                res[d][11].append([int(ends[f] - sizes[f] - text_end[d]), int(ends[e - 1] - text_end[d])])
            for r in res:
                r[7] = sorted(set(r[7]))
            out += res
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])
    return decide


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs`` with its repeated and dropped byte spans (UTF-8 offsets).

    Columns: doc_id, text_key (xxhash64 of the text), n_chunks, n_repeated (chunks that another document holds too),
    repeated_words and longest_run_words (of runs of at least ``min_words``; a run with fewer word starts counts a word
    for every ``WORD_CHARS`` code points), dropped_words (of runs that a
    document with a smaller id keeps), keep_ids (documents that keep them), repeated_spans, dropped_spans; inner_words and
    inner_spans of passages that stood earlier in the same document (the first place stays). Null or empty text
    has no chunks, an empty table gives no rows. Rows that share a doc_id (null ids share the smallest one) keep a repeated passage each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        id_key(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.col("text").cast("string").alias("text"))
    owners = range_count(rows, "text", OWNER_BYTES)
    tables = stored(_tables(rows, owners), "chunks", "kind")
    blocks = tables.where("kind = 0").selectExpr("part", "seq", "a doc_ids", "b text_keys", "c chunks", "d sizes",
                                                 "e words", "f chars", "g place")
    asks = tables.where("kind = 1").selectExpr("part", "seq", "owner", "base", "a digests", "b counts", "c docs")
    answers = asks.groupBy("owner").applyInPandas(_answer, ANSWER_SCHEMA)
    found = (blocks.groupBy("part", "seq").cogroup(answers.groupBy("part", "seq"))
             .applyInPandas(_decide(min_words), OUT_SCHEMA))
    return found.withColumns({"doc_id": id_back(F.col("doc_id")),
                              "keep_ids": F.transform("keep_ids", lambda x: id_back(x))})


def strip(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with the dropped spans and those repeated inside a document cut out, by a join on id and text hash."""

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            texts = []
            for raw, spans in zip(batch.column(1).cast("binary").to_pylist(), batch.column(2).to_pylist(), strict=True):
                if raw is not None and spans:
                    kept, at = [], 0
                    for s, e in sorted(spans):
                        kept.append(raw[at:max(s, at)])
                        at = max(at, e)
                    raw = b"".join([*kept, raw[at:]])
                texts.append(None if raw is None else raw.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    every = F.concat("dropped_spans", "inner_spans")
    spans = found.where(F.size(every) > 0).groupBy("doc_id", "text_key").agg(F.first(every).alias("dropped_spans"))
    same = rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["text_key"] == spans["text_key"])
    return rows.join(spans, same, "left").select(rows["doc_id"], "text", "dropped_spans").mapInArrow(
        cut, "doc_id long, text string")
