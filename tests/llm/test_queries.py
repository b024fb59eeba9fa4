"""The queries over the smallest tables, against SQL or brute force."""

from pathlib import Path

import duckdb
import pytest

from textweft.llm import queries, sql


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    text = sql.oracle_sql().get(name)
    if text:
        got = duck.execute(text)
        order = [d[0] for d in got.description]
        assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r[df.columns.index(c)] for c in order)) for r in rows)


@pytest.mark.parametrize("name,columns", [("p1", ["top_name"]), ("p2", ["row_id"]), ("p3", ["record_id_a", "record_id_b"]), ("p4", ["vec_id_a", "vec_id_b"]), ("p5", ["row_id_a", "row_id_b"]), ("p6", ["row_id_a", "row_id_b"]), ("p7", ["doc_id", "item_id"]), ("p8", ["source"]), ("p9", ["doc_id", "subject"])])
def test_columns(spark, data, name, columns):
    assert queries.queries()[f"{name}_found"](spark, data).columns == columns
