"""Language identification by compression (operator 3).

One zstandard raw-content dictionary per language is cut from a bounded sample
of labelled texts. A text is cut into blocks, every block is compressed with
every dictionary, and the language with the fewest bytes in all wins. When the
best and the second best are close, the row is marked as rejected.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.frames import pick

#: Bound of the training sample: documents per language and bytes per dictionary; every document gives an even share.
SAMPLE_DOCS = 400
DICT_BYTES = 256 << 10
LEVEL = 9
BLOCK_CHARS = 4_096
#: A relative lead of the best language below this marks the row as rejected.
MIN_MARGIN = 0.01
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-case letters, everything else one space."""
    return _OTHER.sub(" ", text.lower()).strip()


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content per language, the most frequent language first.

    Learns from rows with text and language for which ``learn`` (over doc_id) holds: per language the
    ``sample_docs`` rows with the smallest hash of their id, of each an even share of the dictionary from a place that the
    id's hash draws. Memory is bounded by the number of languages.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(learn, F.lit(False)))
    share = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not share:
        return {}
    # a hash limit per language lets about three times the sample through, however large the corpus is
    limits = docs.sparkSession.createDataFrame(
        [(lang, min(1.0, 3 * sample_docs / n)) for lang, n in share.items()], "lang string, share double")
    place = F.xxhash64("doc_id").cast("double") / float(1 << 64) + 0.5
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "part")
    share_bytes = max(1, dict_bytes // sample_docs - 1)  # and a space
    chars = F.lit(share_bytes)
    begin = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    best = (rows.join(F.broadcast(limits), "lang").where(place <= F.col("share"))
            .select("lang", "doc_id", F.substring("text", begin.cast("int"), chars).alias("part"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs))
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in best.select("lang", "rank", "part").toLocalIterator():
        texts.setdefault(row["lang"], []).append(
            (row["rank"], normalise(row["part"]).encode()[:share_bytes].decode("utf-8", "ignore")))
    out = {}
    for lang in sorted(texts, key=lambda x: (-share[x], x)):
        raw = " ".join(t for _, t in sorted(texts[lang], reverse=True)).encode()  # the first samples end nearest
        out[lang] = raw[-dict_bytes:]
    return out


class Classifier:
    """Compressors of all languages; ``predict`` gives (language, score, rejected)."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z
        self.langs, self.coders = [], []
        for lang, raw in dictionaries.items():
            if len(raw) < 8:  # too little text to be a dictionary
                coder = z.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
            else:
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                coder = z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False,
                                         write_dict_id=False)
            self.langs.append(lang)
            self.coders.append(coder.compress)

    def sizes(self, text: str) -> list[int]:
        blocks = [text[i:i + BLOCK_CHARS].encode("utf-8", "surrogatepass") for i in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(code(b)) for b in blocks) for code in self.coders]

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        clean = normalise(text) if text else ""
        if not self.langs or not any(c.isalpha() for c in clean):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(clean)
        best = min(range(len(sizes)), key=sizes.__getitem__)  # a tie goes to the more frequent language
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (rest - sizes[best]) / max(rest, 1)
        return self.langs[best], min(1.0, max(0.0, margin)), margin < min_margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
            min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (relative lead of the best, 0 to 1), rejected.

    Null text or text without a letter is ``und`` with score 0. Other rejected rows keep the best language,
    so the caller chooses what a narrow margin means.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        import pyarrow as pa
        model = Classifier(sent.value)
        for batch in batches:
            found = [model.predict(t, min_margin) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows outside the held-out fold, predict every row. A row without an id is neither held out nor
    learnt from; repeated rows get equal predictions; an empty table has none."""
    doc_id = F.col("doc_id")
    model = fit(docs, doc_id.isNotNull() & ~held_out(doc_id), id_col, text_col, lang_col)
    return (predict(docs, model, id_col, text_col)
            .select("doc_id", held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected"))
