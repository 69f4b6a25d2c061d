import random

import numpy as np

from riskspark.llm import chunk_dedup as C


def test_gear_is_a_window_hash():
    data = bytes(random.Random(1).randrange(256) for _ in range(300))
    h = C.gear(np.frombuffer(data, dtype=np.uint8))
    for at in (15, 100, 299):
        want = sum(int(C._GEAR[data[at - k]]) << k for k in range(16)) & 0xFFFFFFFF
        assert int(h[at]) & int(C._MASK) == want & int(C._MASK)


def test_chunks_cover_each_text():
    rng = random.Random(2)
    run = [bytes(rng.randrange(97, 105) for _ in range(n)) for n in (0, 5, 3000, 0, 40)] + [b"z" * 2000]
    n, ends = C.chunk_ends(run)
    assert n.tolist()[0] == 0 and n.tolist()[3] == 0
    assert ends[-1] == sum(map(len, run))
    sizes = np.diff(ends, prepend=0)
    assert sizes.max() <= C.MAX_CHUNK
    assert set(np.cumsum([len(b) for b in run])) <= {0, *ends.tolist()}


def test_planted_passages_and_clean_documents(frame):
    from .conftest import prose
    rng = random.Random(7)
    passages = [prose(rng, 60) for _ in range(12)]
    texts = [prose(rng, 200) for _ in range(60)]
    planted = {}
    for k, p in enumerate(passages):
        for d in rng.sample(range(40), 3):
            planted.setdefault(d, []).append(k)
            words = texts[d].split()
            at = rng.randrange(len(words))
            texts[d] = " ".join(words[:at] + [p] + words[at:])
    repeats = prose(rng, 25)
    texts.append(" ".join([repeats] * 4))  # repeats itself, in no other document
    got = {r["doc_id"]: r for r in C.repeated_passages(frame(texts)).collect()}
    holders = {k: sorted(d for d, ks in planted.items() if k in ks) for k in range(len(passages))}
    caught = sum(got[d]["repeated_words"] >= C.MIN_WORDS for d in planted)
    assert caught >= 0.97 * len(planted)
    assert all(got[d]["repeated_words"] == 0 for d in range(len(texts)) if d not in planted)
    later = {d for hs in holders.values() for d in hs[1:]}
    assert sum(got[d]["dropped_words"] > 0 for d in later) >= 0.97 * len(later)
    assert all(got[d]["dropped_words"] == 0 for d in planted if d not in later)
    for d in later:
        assert set(got[d]["keep_ids"]) <= set(planted)


def test_copies_and_strip(frame):
    from .conftest import prose
    text = prose(random.Random(8), 100)
    docs = frame([text, text, "other words here", text, None, ""])
    found = C.repeated_passages(docs)
    kept = {r["doc_id"]: r["text"] for r in C.strip(docs, found).collect()}
    assert kept == {0: text, 1: "", 2: "other words here", 3: "", 4: None, 5: ""}


def test_passages_without_spaces(frame):
    rng = random.Random(9)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(n))
    listed = lambda n: ",".join(str(rng.randrange(10**6)) for _ in range(n))
    wide = lambda n: "\u3000".join(thai(5) for _ in range(n))
    for make, size in ((han, 300), (thai, 300), (listed, 60), (wide, 60)):
        shared, own = make(size), [make(size) for _ in range(4)]
        texts = [own[0] + shared + own[1], own[2] + shared + own[3], make(2 * size), make(3 * size)]
        docs = frame([*texts, texts[3]])
        found = C.repeated_passages(docs)
        got = {r["doc_id"]: r for r in found.collect()}
        assert all(got[d]["repeated_words"] >= C.MIN_WORDS for d in (0, 1, 3, 4))
        assert [d for d in got if got[d]["dropped_spans"]] == [1, 4] and got[1]["keep_ids"] == [0]
        assert got[2]["repeated_words"] == 0
        kept = {r["doc_id"]: r["text"] for r in C.strip(docs, found).collect()}
        assert kept[0] == texts[0] and kept[3] == texts[3] and kept[4] == ""
        (start, end), = got[1]["dropped_spans"]
        raw = texts[1].encode()
        assert kept[1] == raw[:start].decode() + raw[end:].decode()  # no code point is cut
        assert raw[start:end].decode() in shared and end - start >= 0.7 * len(shared.encode())


def test_edge_rows(edges, nothing, all_null, edge_texts):
    got = C.repeated_passages(edges).collect()
    assert len(got) == len(edge_texts)
    assert C.repeated_passages(nothing).count() == 0
    assert {r["n_chunks"] for r in C.repeated_passages(all_null).collect()} == {0}
    assert C.strip(edges, C.repeated_passages(edges)).count() == len(edge_texts)


def test_repeats_inside_a_document_keep_their_first_place(frame):
    from .conftest import prose
    rng = random.Random(12)
    passage, own, line = prose(rng, 120), [prose(rng, 30) for _ in range(50)], prose(rng, 6)
    many = " ".join(f"{o} {passage}" for o in own)
    lines = "\n".join([line] * 40)
    texts = [many, prose(rng, 300), lines, f"{passage} {prose(rng, 40)}", None]
    docs = frame(texts)
    found = C.repeated_passages(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[0]["inner_words"] >= 49 * 100 and len(got[0]["inner_spans"]) >= 49
    assert got[1]["inner_words"] == 0 and got[1]["inner_spans"] == [] and got[4]["inner_words"] == 0
    assert got[2]["inner_words"] >= 6 * 30 and got[2]["repeated_words"] == 0
    assert got[3]["dropped_words"] > 0 and got[3]["inner_words"] == 0
    kept = {r["doc_id"]: r["text"] for r in C.strip(docs, found).collect()}
    assert passage in kept[0] and kept[0].count(passage[200:400]) == 1 and all(o in kept[0] for o in own)
    assert len(kept[0]) < 0.35 * len(many) and kept[1] == texts[1] and line in kept[2] and len(kept[2]) < len(lines) / 4
    assert passage[200:400] not in kept[3]


def test_a_long_text_is_chunked_whole(frame):
    from .conftest import prose
    rng = random.Random(13)
    passage = prose(rng, 80)
    long = " ".join(f"{prose(rng, 400)}" for _ in range(900))
    assert len(long) > C.BLOCK_BYTES
    got = {r["doc_id"]: r for r in C.repeated_passages(frame([f"{long} {passage}", f"{passage} {prose(rng, 50)}"])).collect()}
    assert got[0]["repeated_words"] >= 60 and got[1]["dropped_words"] >= 60
