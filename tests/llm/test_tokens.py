import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskspark.llm import wavelet as W
from riskspark.llm.queries import END_ID, tokenizer_path
from riskspark.llm.tokens import PieceEncoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_document_index_equals_brute_force(edges, edge_texts, edge_ids, tokenizer):
    got = W.tokenise(edges, tokenizer_path(), END_ID, shard_tokens=5_000).orderBy("start").collect()
    by_id = {}
    for i, t in zip(edge_ids, edge_texts, strict=True):
        by_id.setdefault(i, []).append(t)
    rows, seen = [], {}
    for r in got:  # rows that share an id may stand in any order among themselves
        rows.append((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]))
    keys = [r[0] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert [r[1] for r in rows] == list(np.cumsum([0] + [r[2] for r in rows[:-1]]))
    want = sorted((str(d), n, c) for i, ts in by_id.items() for d, _, n, c in expected(tokenizer, [(i, t) for t in ts]))
    assert sorted((str(d), n, c) for d, _, n, c in rows) == want
    assert not seen


def test_empty_and_null_tables(nothing, all_null):
    assert W.tokenise(nothing, tokenizer_path(), END_ID).count() == 0
    assert {r["n_tokens"] for r in W.tokenise(all_null, tokenizer_path(), END_ID).collect()} == {1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'sé 　\n\t.1<|>Z日"), max_size=60), max_size=8),
       st.sampled_from([7, 40, 1 << 20]))
def test_pieces_encode_like_whole_texts(texts, step):
    coder = test_pieces_encode_like_whole_texts.coder
    got = []
    for _, n, ids in coder.encode(texts, step):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [coder.tok.encode(t, add_special_tokens=False).ids for t in texts]


test_pieces_encode_like_whole_texts.coder = PieceEncoder(tokenizer_path())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400))
def test_wavelet_matrix_answers(values):
    a = np.array(values, dtype=np.uint32)
    shard = W.Shard(W.pack_shard([1, None], np.array([len(a), 0]), a))
    m = shard.matrix
    assert shard.doc_ids == [1, None]
    assert m.decode().tolist() == values
    for i in range(0, len(a), 17):
        assert m.access(i) == a[i]
    for symbol in {*values[:5], 301, 70_000}:
        at = np.flatnonzero(a == symbol)
        assert m.occurrences(symbol).tolist() == at.tolist()
        assert m.count(symbol) == len(at)
        assert m.rank(symbol, len(a) // 2) == (at < len(a) // 2).sum()
        if len(at):
            assert m.select(symbol, len(at) - 1) == at[-1]


def test_corpus_occurrences(spark, frame, tokenizer):
    from riskspark.llm.frames import scratch
    texts = ["one two", "two two", "three"]
    path = scratch(spark, "test")
    W.write_shards(frame(texts), path, tokenizer_path(), END_ID, shard_tokens=3)
    ids = [x for t in texts for x in [*tokenizer.encode(t, add_special_tokens=False).ids, END_ID]]
    token = tokenizer.encode(" two", add_special_tokens=False).ids[0]
    got = sorted(r["position"] for r in W.occurrences(W.read_shards(spark, path), [token, END_ID]).collect())
    assert got == [i for i, x in enumerate(ids) if x in (token, END_ID)]


def test_tokenizer_gets_short_strings(tokenizer):
    """Its time a byte grows with the length of a string; ids don't depend on where pieces are joined."""
    text = " ".join(f"w{i * 7919 % 99991}ord" for i in range(4000))
    enc, longest = PieceEncoder(tokenizer_path()), []
    batch = enc.batch
    enc.batch = lambda texts, **kw: longest.append(max(map(len, texts))) or batch(texts, **kw)
    (_, n, ids), = enc.encode([text])
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]
    assert max(longest) < 2048


def test_planes_split_and_merge_in_runs(monkeypatch):
    ids = np.random.default_rng(2).integers(0, 70_000, 1_000).astype(np.uint32)
    whole = W.pack_shard([1], np.array([len(ids)]), ids)
    for run in (1, 7, 999, 1_000):
        monkeypatch.setattr(W, "RUN_IDS", run)
        assert W.pack_shard([1], np.array([len(ids)]), ids) == whole
        assert W.Shard(whole).matrix.decode().tolist() == ids.tolist()


def test_pieces_end_at_line_feeds():
    """A word before and after a line feed is no new piece: the tokenizer sees each of the few words once."""
    enc, sent = PieceEncoder(tokenizer_path()), []
    batch = enc.batch
    enc.batch = lambda texts, **kw: sent.extend(texts) or batch(texts, **kw)
    text = "\n".join(f"word{i % 30} end{i % 29}." for i in range(870))
    (_, _, ids), = enc.encode([text])
    assert ids.tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert sum(map(len, sent)) < 1000
