"""The queries of the subpackage on the smallest tables: those with SQL give what DuckDB gives, the others have their columns and rows."""

import glob
import os

import pytest

from lexloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
COLUMNS = {
    "p1_found": {"record", "start_at"}, "p2_found": {"book_id_1", "start_1", "book_id_2", "start_2"}, "p3_found": {"sentence_id", "group_id"}, "p4_found": {"word_id", "plain_word"},
    "p5_found": {"field", "term", "mark"}, "p6_found": {"doc_id", "item_id"}, "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted([repr(tuple(r[names.index(c)] for c in cols)) for r in want.fetchall()])
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == rows


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert set(df.columns) == COLUMNS.get(name, set(df.columns))
    rows = df.collect()
    assert rows and len(set(map(repr, rows))) == len(rows)
