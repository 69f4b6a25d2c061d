import zlib

from riskspark.llm import language as L
from riskspark.llm.queries import table

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_isolation(spark):
    docs = table(spark, SF01, "documents")
    got = {r["doc_id"]: r for r in L.identify(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values()) == len(held)
    known = [i for i in held if lang[i]]
    assert sum(got[i]["lang_pred"] == lang[i] for i in known) / len(known) > 0.96
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # the labels of the held-out fold, sources and ids don't matter
    from pyspark.sql import functions as F
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = {r["doc_id"]: r["lang_pred"] for r in L.identify(other.withColumn("source", F.lit("s"))).collect()}
    assert again == {i: r["lang_pred"] for i, r in got.items()}


def test_edge_rows(edges, nothing, all_null, edge_texts):
    got = L.identify(edges).collect()
    assert len(got) == len(edge_texts)
    assert sum(r["lang_pred"] == "und" for r in got) == sum(
        not any(c.isalpha() for c in (t or "")) for t in edge_texts)
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert L.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in L.identify(all_null).collect()} == {"und"}


def test_predictions_are_those_of_plain_compression(spark):
    """Every prediction against zstandard called text by text and block by block."""
    import zstandard as z
    from pyspark.sql import functions as F
    docs = table(spark, SF01, "documents").where("doc_id < 150")
    model = L.fit(table(spark, SF01, "documents"), ~L.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in L.predict(docs, model).collect()}
    for row in docs.collect():
        clean = L.normalise(row["text"] or "")
        if not any(c.isalpha() for c in clean):
            assert got[row["doc_id"]]["lang_pred"] == "und"
            continue
        sizes = {}
        for lang, raw in model.items():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=L.LEVEL)
            coder = z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(clean[i:i + L.BLOCK_CHARS].encode()))
                              for i in range(0, len(clean), L.BLOCK_CHARS))
        best = min(sizes, key=sizes.get)
        rest = min(v for k, v in sizes.items() if k != best)
        assert got[row["doc_id"]]["lang_pred"] == best
        assert abs(got[row["doc_id"]]["score"] - (rest - sizes[best]) / rest) < 1e-12


def test_every_sampled_document_gives_an_even_share(frame):
    from pyspark.sql import functions as F
    names = [f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(40)]
    docs = frame([" ".join(name + "z" * (k % 3) for k in range(5000)) for name in names])
    model = L.fit(docs, F.lit(True), sample_docs=40, dict_bytes=8000)
    found = model["en"].decode().replace("z", "").split()
    places = [found.count(name) for name in names]
    assert min(places) > 20 and max(places) < 2 * min(places) and len(model["en"]) <= 8000


def test_a_tie_goes_to_the_more_frequent_language():
    model = L.Classifier({"aa": b"same words here " * 20, "bb": b"same words here " * 20})
    lang, score, rejected = model.predict("same words here")
    assert (lang, score, rejected) == ("aa", 0.0, True)
