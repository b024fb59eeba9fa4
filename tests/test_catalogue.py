"""Every query with a SQL counterpart gives the same rows in both engines."""

import json
import math
from pathlib import Path

import duckdb
import pytest

from textweft.operators import report
from textweft.operators.phrases import common_phrases
from textweft.plans import catalogue

#: Those without a SQL counterpart; their values are checked below.
CHECKED_BELOW = {"report_json", "analyze_file_report", "exact_phrases", "mlp_predict", "flagship"}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert name in CHECKED_BELOW and df.columns
        return
    got = duck.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in got.fetchall())
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.queries()) >= set(catalogue.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_held_out_vectors_get_labels(spark, data):
    # the labels of the test vectors are drawn at random, so what can be asked is that all and only held-out rows are there
    rows = catalogue.mlp_predict(spark, data).collect()
    total = spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert 0.15 * total < len(rows) < 0.25 * total and {r["prediction"] for r in rows} <= {r["label"] for r in rows}


def phrases_of(row):
    return common_phrases(row["query_text"], row["db_text"])


@pytest.mark.parametrize("query,key,threshold", [("report_json", "report", 0.5), ("analyze_file_report", "report", 0.85)])
def test_reports_hold_together(spark, data, query, key, threshold):
    reports = [json.loads(r[key]) for r in catalogue.queries()[query](spark, data).collect()]
    assert len(reports) == 300
    whole = [r for r in reports if "error" not in r]
    assert 200 < len(whole) and all(set(r) == {"error"} for r in reports if "error" in r)
    some = 0
    for r in whole:
        assert r["analysis_config"]["threshold_used"] == threshold and r["total_reported_sources"] == len(r["sources"]) <= min(10, r["total_suspicious_sources"])
        counts = [s["match_count"] for s in r["sources"]]
        assert counts == sorted(counts, reverse=True)
        exact = [s["has_exact_copies"] for s in r["sources"]]
        assert all(exact) or not any(exact)
        for s in r["sources"]:
            assert s["match_count"] == len(s["matches"]) <= 5
            assert s["average_similarity_percent"] == pytest.approx(sum(m["match_percentage"] for m in s["matches"]) / len(s["matches"]), abs=0.0051)
            assert s["has_exact_copies"] == any(m["exact_copied_phrases"] for m in s["matches"])
            for m in s["matches"][:1]:
                assert m["exact_copied_phrases"] == phrases_of(m) and m["cosine_similarity"] >= threshold - 1e-4
                some += bool(m["exact_copied_phrases"])
    assert some > 5


def test_phrases_are_those_of_the_matcher(spark, data):
    got = {}
    for r in catalogue.exact_phrases(spark, data).collect():
        got.setdefault((r["item_id"], r["q_chunk"], r["doc_id"], r["chunk"]), []).append(r["phrase"])
    m, q, c = catalogue._matches(spark, data)
    pairs = catalogue._with_texts(report.top_matches(m), q, c).collect()
    want = {(r["q_doc"], r["q_chunk"], r["doc"], r["chunk"]): phrases_of(r) for r in pairs}
    assert got and {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_flagship(spark, data):
    rows = catalogue.flagship(spark, data).collect()
    rough = {r["item_id"]: r for r in catalogue.analyze_report(spark, data).collect()}
    assert len(rows) == 300 and all(r["error"] or r["global_score"] == rough[r["item_id"]]["global_score"] for r in rows)
