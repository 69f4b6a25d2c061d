import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns whose names operators use inside
    *[T.StructField(c, T.IntegerType()) for c in ("id", "tid", "key", "part", "seq", "row", "digest", "size", "target",
                                                  "alone", "top", "start")]])

SYLLABLES = "ba de fi go lu ma ne po ra si tu ve za ki mo".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def rows_of(texts, ids=None, langs=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, (langs or {}).get(k, "en"), (sources or {}).get(k, f"s{k % 3}"), None if t is None else len(t),
             *[7] * 12) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, **kw):
        return spark.createDataFrame(rows_of(texts, **kw), SCHEMA)
    return make


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and blank texts, repeated rows, one very long text, odd characters."""
    rng = random.Random(3)
    base = prose(rng, 120)
    long = prose(rng, 60_000)
    texts = [base, base, None, "", " \t\n", "wort", "Ünï­ çödé 日本語   x", base + " tail", long, "a b  c\n\n d",
             "tail <|endoftext|> x", "  lead", "0123 abc　def", base.upper(), "'s 're don't  ..  !?"]
    return [*texts, *[prose(rng, 40) for _ in range(10)], base]


@pytest.fixture(scope="session")
def edge_ids():
    """Ids of the edge rows: two nulls, one id twice."""
    return [5, 9, 3, 4, 8, 11, None, 12, 13, 14, 15, 16, 17, 18, 19, *range(30, 39), None, 5]


@pytest.fixture(scope="session")
def edges(frame, edge_texts, edge_ids):
    return frame(edge_texts, ids=edge_ids, sources={0: None, 2: None, 5: "z"}, langs={3: None})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def all_null(spark):
    return spark.createDataFrame([(None,) * 17] * 3, SCHEMA)
