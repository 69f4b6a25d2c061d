import hashlib
import random
import re

from riskspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(10, len(b))
        for k in range(len(b) - n + 1 if b else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == b[k:k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item or "")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_equals_brute_force(spark, frame, nothing):
    from .conftest import prose
    rng = random.Random(5)
    passage, short = prose(rng, 35), "Zaz zaz  ZUZ"
    items = [("10", passage), ("9", passage[len(passage) // 2:]), ("2", short), ("3", None), ("4", "..."), ("5", "qqq"),
             (None, prose(rng, 12)), ("10", prose(rng, 15))]
    texts = [prose(rng, 50), passage, f"{prose(rng, 5)} {passage.upper()}, {prose(rng, 5)} {passage}", None, "", "zaz zaz zuz zaz",
             "zaz zaz. zuz", "qqq qqq x qqq", items[-2][1], " ".join(passage.split()[:9]), " ".join(passage.split()[3:14]),
             "zaz", "zaz zuz", passage]
    docs = frame(texts, ids=[*range(len(texts) - 2), None, 1])
    bench = spark.createDataFrame(items, "item_id string, text string")
    for options in ({}, {"block_windows": 7}):
        got = D.contamination(docs, bench, **options).collect()
        have = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                      for r in got)
        ids = [*range(len(texts) - 2), None, 1]
        assert have == sorted((str(i), *brute(t, items)) for i, t in zip(ids, texts, strict=True))
    assert D.contamination(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in D.contamination(docs, bench.limit(0)).collect())


def test_edge_rows(spark, edges, edge_texts, all_null):
    items = [("a", edge_texts[8][-200:]), ("b", edge_texts[0])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((r["n_words"], r["n_hit"]) for r in D.contamination(edges, bench).collect())
    short = [t for t in edge_texts if t is None or len(t) < 5_000]
    assert [x for x in got if x[0] < 50_000] == sorted(brute(t, items)[:2] for t in short)
    assert [x[1] > 20 for x in got if x[0] >= 50_000] == [True]
    assert {r["n_words"] for r in D.contamination(all_null, bench).collect()} == {0}


def test_long_texts_are_cut_between_words():
    from riskspark.llm.textbuf import words_of
    text = "abc defg " * 500
    whole = next(words_of([text]))
    cut = next(words_of([text], 100))
    assert cut[1].tolist() == whole[1].tolist() and (cut[2] == whole[2]).all()


def test_proximity(spark, frame):
    phrase = "alpha beta gamma delta epsilon"
    bench = spark.createDataFrame([("1", phrase)], "item_id string, text string")
    docs = frame([phrase, "alpha beta x gamma delta epsilon", "alpha x x x beta gamma delta epsilon", "alpha beta gamma"])
    near = {r["doc_id"] for r in D.matches(docs, bench, slop=1).where("item is not null").collect()}
    exact = {r["doc_id"] for r in D.matches(docs, bench).where("item is not null").collect()}
    assert exact == {0} and near == {0, 1}
