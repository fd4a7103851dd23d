import os

import pytest

import __spark_entry__

from .conftest import SF

CORE = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]
SOME = ["knn_linear_l2", "knn_hamming", "radius_count", "vote_majority", "recall_at_k", "gonzales_centers", "lsh_buckets", "kd_single_exact"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(CORE) > 60


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name]).to_arrow_table()
    assert sorted(df.columns) == sorted(want.column_names)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(zip(*(want[c].to_pylist() for c in columns), strict=True))


def test_every_document_asks_the_medoid_trees(spark):
    """Those of equal bits ask once, and count for as many as they are."""
    import duckdb

    got = __spark_entry__.queries()["medoid_hamming_recall"](spark, SF).first()
    documents = duckdb.sql(f"SELECT count(DISTINCT doc_id) FROM '{SF}/documents.parquet' WHERE length(text) > 0").fetchall()[0][0]
    assert got["reaches"] and got["total"] == 5 * documents
    want = duckdb.sql(__spark_entry__.oracle_sql()["medoid_hamming_recall"].replace("FROM documents", f"FROM '{SF}/documents.parquet'")).fetchall()[0]
    assert tuple(got) == want
