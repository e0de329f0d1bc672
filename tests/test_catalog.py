"""Every catalogued query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

from chunkloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(cursor_rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in cursor_rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, db):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("kind", ["md", "xml", "rtf", "cp1252"])
def test_blank_documents_are_an_empty_paragraph(kind, spark, tmp_path):
    """Documents without a line: null, empty, or white space alone. None is lost as a file of a text format."""
    texts = [None, "", "  ", "\n\n", "\t\r\n ", "# a\n\nb"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalog.QUERIES[f"file_{kind}"](spark, str(tmp_path)), con.sql(catalog.ORACLES[f"file_{kind}"])
    assert {r.doc_id for r in got.collect()} == set(range(len(texts)))
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
