from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textweft import schemas
from textweft.functions import contact
from textweft.operators import classify, labels, phrases, registry, report, similarity


def test_common_phrase_golden():
    assert phrases.common_phrases("the cat sat on the mat and ran far", "a bat sat on the mat and ran fast") == ["at sat on the mat and ran fa"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a bb ccc d ee".split()), max_size=40), st.lists(st.sampled_from("a bb ccc d ee".split()), max_size=40))
def test_prefilter_loses_no_phrase(a, b):
    x, y = " ".join(a), " ".join(b)
    if phrases.common_phrases(x, y):
        grams = {tuple(a[i : i + 4]) for i in range(len(a) - 3)}
        assert grams & {tuple(b[i : i + 4]) for i in range(len(b) - 3)}


def test_exact_phrases_operator(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat and ran far", "a bat sat on the mat and ran fast"), (2, None, "x"), (3, "", ""), (4, "no word here", "is shared at all")], "k int, a string, b string")
    got = {r["k"]: r["phrases"] for r in phrases.exact_phrases(rows, "a", "b").collect()}
    assert got == {1: ["at sat on the mat and ran fa"], 2: [], 3: [], 4: []}
    assert SequenceMatcher(None, "", "", autojunk=False).get_matching_blocks()


def match_rows(spark, rows):
    return spark.createDataFrame(rows, "q_doc int, q_chunk int, doc string, chunk int, cosine double, rank int, exact boolean")


def ranked(spark, rows):
    m = report.scored(match_rows(spark, rows), 0.5)
    top = report.top_matches(m)
    return {r["doc"]: r for r in report.rank_sources(top, report.first_seen(m), "exact").collect()}


def test_ranking_prefers_exact_after_truncation(spark):
    a = [(1, i, "A", i, c, 1, c == 0.90) for i, c in enumerate([0.99, 0.98, 0.97, 0.96, 0.95, 0.90])]
    out = ranked(spark, [*a, (1, 7, "B", 0, 0.8, 1, True)])
    assert set(out) == {"B"}
    out = ranked(spark, [*a, (1, 7, "B", 0, 0.8, 1, False)])
    assert out["A"]["match_count"] == 5 and not out["A"]["has_exact"] and out["A"]["position"] == 1 and out["B"]["position"] == 2


def test_equal_counts_keep_first_seen_order(spark):
    out = ranked(spark, [(1, 0, "Z", 0, 0.7, 1, False), (1, 1, "A", 0, 0.9, 1, False)])
    assert out["Z"]["position"] == 1


def test_global_score_counts_a_chunk_once(spark):
    m = report.scored(match_rows(spark, [(1, 0, "A", 0, 1.2, 1, False), (1, 0, "B", 0, 0.6, 2, False), (1, 1, "A", 1, 0.4, 1, False)]), 0.5)
    q = spark.createDataFrame([(1, 0, "x", 30), (1, 1, "y", 70), (2, 0, "z", 20)], "doc int, chunk_id int, chunk_text string, n_words int")
    out = {r["q_doc"]: r for r in report.global_scores(m, q).collect()}
    assert out[1]["global_score"] == 30.0 and out[1]["total_suspicious_sources"] == 2 and out[1]["total_flagged_chunks"] == 1
    assert out[2]["global_score"] == 0.0


def test_top_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [1.0] * 3), (63, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in similarity.top_vectors(df, df, "id", "v", k=4, width=8, block=17).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["n"]))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert set(got) == set(range(60))
    for i in range(60):
        assert [n for _, n in sorted(got[i])] == sorted(range(60), key=lambda j: (-round(s[i, j], 12), j))[:4]


def test_top_texts_against_brute_force(spark):
    texts = ["a b c a", "a b", "c c d", "e f", "a b c a", "z"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, chunk_id int, chunk_text string")
    got = {(r["q_doc"], r["doc"]): r["cosine"] for r in similarity.top_texts(rows, rows, k=10, least=0.01, block=2).collect()}
    from collections import Counter
    from math import sqrt

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = Counter(a.split()), Counter(b.split())
            dot = sum(x[w] * y[w] for w in x)
            if dot:
                assert got[i, j] == pytest.approx(dot / sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())))
            else:
                assert (i, j) not in got


@pytest.mark.parametrize("n,sizes", [(10, (8, 1, 1)), (29, (23, 2, 4)), (7, (5, 0, 2))])
def test_split_sizes(spark, n, sizes):
    rows = spark.createDataFrame([(i, "a") for i in range(n)], "id long, label string")
    got = {r["split"]: r["count"] for r in labels.stratified_split(rows, "label", "id").groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_split_keeps_null_labels_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "id long, label string")
    assert labels.stratified_split(rows, "label", "id").count() == 2
    assert labels.stratified_split(rows.limit(0), "label", "id").count() == 0


def test_label_fallback_order(spark):
    tax = spark.createDataFrame([("a.X", "a", "Ay", "Ex"), ("b.Y", "b", "Be", "Why")], "sub_code string, top_code string, top_name string, sub_name string")
    rows = spark.createDataFrame([(1, "b.Y", ["a.X"]), (2, "?", ["!", "a.X", "b.Y"]), (3, None, None), (4, "?", [])], "id int, p string, o array<string>")
    assert {r["id"]: r["top_code"] for r in labels.map_labels(rows, tax, "id", "p", "o").collect()} == {1: "b", 2: "a"}


def test_first_wins(spark):
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), (None, 0, "c"), ("y", 5, None)], "id string, pos int, v string")
    assert {(r["id"], r["v"]) for r in labels.first_wins(rows, ["id"], [F.col("pos")]).collect()} == {("x", "a"), ("y", None)}


def users(spark):
    rows = [(1, "A", "B", "a@x.y", None, None, None, False, None), (2, "C", "D", "c@x.y", None, "g2", None, True, None), (3, "", None, "E@x.y ", None, None, None, False, None)]
    return spark.createDataFrame(rows, schemas.USERS)


def test_account_linking(spark):
    p = spark.createDataFrame([("g2", "z@x.y", "Z", "Z"), ("g9", "e@x.Y", "E", "E"), ("g8", "c@x.y", "N", "N")], "google_id string, email string, given_name string, family_name string")
    got = {r["google_id"]: (r["user_id"], r["action"]) for r in registry.link_accounts(users(spark), p).collect()}
    # a deleted account is known by its id, but not linked by its address
    assert got == {"g2": (2, "known"), "g9": (3, "linked"), "g8": (None, "created")}
    after = {r["id"]: r["google_id"] for r in registry.merge_accounts(users(spark), p).collect()}
    assert after == {1: None, 2: "g2", 3: "g9", 4: "g8"}


def test_reports_join_and_validity(spark):
    up = spark.createDataFrame([(1, 1, "f", "p", None, "PENDING", None, False, False, None), (2, 1, "g", "p", 3, "FAILED", None, False, True, None), (3, 1, "h", "p", 3, "FAILED", None, False, False, None)], schemas.UPLOADS)
    rep = spark.createDataFrame([(10, 1, 5.0, "{}", None, "m", "i", 0.8, None)], schemas.REPORTS)
    both = {r["id"]: r["report"] for r in registry.with_report(up, rep).collect()}
    assert set(both) == {1, 3} and both[3] is None and both[1]["global_score"] == 5.0
    new = spark.createDataFrame([(1, 20), (2, 21), (2, 22), (9, 23)], "document_id long, id long")
    assert {(r["document_id"], r["id"]) for r in registry.acceptable_reports(new, up, rep).collect()} == {(2, 21)}


def test_contact_expressions(spark):
    rows = spark.createDataFrame([(1, " ada ", "love", "x@y.z"), (2, "ada", None, None), (3, "", " ", "q@y.z"), (4, None, None, None), (5, None, None, " a@b.c")], "i int, f string, l string, e string")
    got = rows.select("i", contact.initials(F.col("f"), F.col("l"), F.col("e")), contact.valid_email(F.col("e")), contact.normal_email(F.col("e"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["AL", "A", "Q", "?", "A"]
    assert [r[2] for r in got] == [True, False, True, False, False]
    assert got[4][3] == "a@b.c"


def test_evaluation_by_hand(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), (None, "a")], "label string, prediction string")
    got = {r["class"]: r for r in classify.evaluation(rows).collect()}
    assert got["a"]["precision"] == 1.0 and got["a"]["recall"] == 0.5
    assert got["b"]["precision"] == round(1 / 3, 4) and got["c"]["f1"] == 0.0
    assert got["accuracy"]["precision"] == 0.5 and got["weighted avg"]["support"] == 4


def test_schema_upgrade(spark):
    old = spark.createDataFrame([(1, "x", 9)], "id int, email string, extra int")
    assert schemas.upgrade(old, "id bigint, email string, google_id string").collect() == [(1, "x", None)]


def test_near_texts_keeps_every_copy(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(i, 0, words) for i in range(12)] + [(50, 0, words + " more"), (51, 0, "other " * 20), (0, 1, words)]
    c = spark.createDataFrame([(d, k, t.strip()) for d, k, t in rows], "doc long, chunk_id int, chunk_text string")
    for block in (1, 100):
        got = similarity.near_texts(c.where("doc IN (0, 51)"), c, 0.8, block=block).collect()
        want = {(q, j, d, k) for q, j in ((0, 0), (0, 1)) for d, k, _ in rows if d != 51 and (d, k) != (q, j)}
        assert len(got) == len(want) == 26 and {(r["q_doc"], r["q_chunk"], r["doc"], r["chunk"]) for r in got} == want
