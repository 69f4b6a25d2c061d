import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """45 customers and 45 vectors, of whose ids 20 divides two."""
    rng, d = np.random.default_rng(3), tmp_path_factory.mktemp("knn")
    ids = np.arange(1, 46)
    pd.DataFrame({"c_custkey": ids, "c_mktsegment": np.array(["A", "B", "C"])[ids % 3],
                  "c_acctbal": rng.normal(size=45).round(2) * 1000, "c_nationkey": ids % 7}).to_parquet(d / "customer.parquet")
    pd.DataFrame({"vec_id": ids, "embedding": list(rng.normal(size=(45, 20)).astype(np.float32)),
                  "label": ids % 4}).to_parquet(d / "embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name,rows", [("approx_knn_customers", 4 * 45), ("knn_classify", 45), ("self_knn", 5 * 45),
                                       ("knn_join", 5 * 45), ("self_knn_text_ids", 5 * 45),
                                       ("knn_missing", 3 * 33 + 12)])
def test_every_row_is_a_query(spark, tables, name, rows):
    got = E.queries()[name](spark, tables).toPandas()
    con = duckdb.connect()
    for t in ("customer", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns[:2])
    got, want = (x.sort_values(key, ignore_index=True).fillna(-1) for x in (got, want))
    assert set(got[key[0]].astype(int)) == set(range(1, 46)) and len(got) == rows
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)
