import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textweft.llm import mix, queries, sample, split
from textweft.llm.common import take_by_threshold

DIM = "top_code string, top_name string, sub_code string, sub_name string"
TARGETS = "top_name string, target_share double, min_rows int"


def papers(spark, n=400):
    rows = [(i, " Physics" if i % 3 else "LAW\t", None, "train" if i % 2 else None, i) for i in range(n)]
    rows += [(n + 1, None, " PHY.q ", "val", 0), (n + 2, "nowhere", "?", "val", 0), (n + 3, "", None, None, 0)]
    # columns named like the operator's own must not matter
    return spark.createDataFrame(rows, "record_id long, top_category_name string, primary_category string, split string, _w long")


def dim(spark):
    return spark.createDataFrame([("phy", "Physics", "phy.Q", "Quantum"), ("law", "Law", "law", "Law")], DIM)


def test_category_resolution(spark):
    got = {r["record_id"]: r["category"] for r in sample.with_category(papers(spark), dim(spark)).collect()}
    assert got[1] == "Physics" and got[0] == "Law" and got[401] == "Physics" and got[402] is None and got[403] is None


def test_sample_follows_targets(spark):
    targets = spark.createDataFrame([("Physics", 0.2, 1), ("Law", 0.75, 1), ("Sport", 0.05, 3)], TARGETS)
    rows = sample.with_category(papers(spark), dim(spark))
    out = sample.target_sample(rows, targets, "record_id", margins=("split",), fraction=0.25)
    assert out.pool == 401 and out.size == 100
    picked = out.rows.collect()
    assert len(picked) == 100 and len({r["record_id"] for r in picked}) == 100
    report = {r["top_name"]: r for r in out.report.collect()}
    assert report["Sport"]["met"] is False and report["Sport"]["sampled_rows"] == 0
    assert report["Law"]["met"] and report["Physics"]["met"]
    assert report["Physics"]["sampled_rows"] + report["Law"]["sampled_rows"] == 100
    assert set(out.rows.columns) == set(rows.columns)


def test_sample_minimum_and_shortage(spark):
    rows = spark.createDataFrame([(i, "A") for i in range(90)] + [(i, "B") for i in range(90, 100)], "record_id long, category string")
    targets = spark.createDataFrame([("A", 0.99, 1), ("B", 0.01, 4)], TARGETS)
    report = {r["top_name"]: r for r in sample.target_sample(rows, targets, "record_id", fraction=0.2).report.collect()}
    assert report["B"]["sampled_rows"] == 4 and report["A"]["sampled_rows"] == 16
    targets = spark.createDataFrame([("A", 0.1, 1), ("B", 0.9, 1)], TARGETS)
    report = {r["top_name"]: r for r in sample.target_sample(rows, targets, "record_id", fraction=0.5).report.collect()}
    assert report["B"]["sampled_rows"] == 10 and not report["B"]["met"] and report["A"]["met"]


def test_sample_of_nothing(spark):
    rows = spark.createDataFrame([], "record_id long, category string")
    targets = spark.createDataFrame([("A", 1.0, 2)], TARGETS)
    out = sample.target_sample(rows, targets, "record_id")
    assert out.rows.count() == 0 and out.report.collect()[0]["missing_rows"] == 2.0


def test_repeated_rows_are_rows(spark):
    rows = spark.createDataFrame([(1, "A")] * 40, "record_id long, category string")
    targets = spark.createDataFrame([("A", 1.0, 1)], TARGETS)
    assert sample.target_sample(rows, targets, "record_id").rows.count() == 10


def test_small_weights_do_not_saturate(spark):
    # weights a million times smaller than others must still be drawn at random, not by key
    rows = spark.createDataFrame([(i, "g", 1e-6 if i % 2 else 1.0) for i in range(4000)], "k long, g string, w double")
    from pyspark.sql import functions as F

    from textweft.llm.common import unit_interval

    ranked = rows.withColumn("r", -F.log(unit_interval(F.col("k"))) / F.col("w")).withColumn("n", F.lit(1))
    quotas = spark.createDataFrame([("g", 3000)], "g string, q long")
    got = take_by_threshold(ranked, ["g"], "r", "k", "n", quotas, "q", scale_free=True).collect()
    light = sorted(r["k"] for r in got if r["w"] < 1)
    assert len(got) == 3000 and len(light) == 1000 and 1700 < np.mean(light) < 2300
    best = sorted(ranked.collect(), key=lambda r: (r["r"], r["k"]))[:3000]
    assert {r["k"] for r in best} == {r["k"] for r in got}


def test_margins_and_their_gaps(spark):
    rows = [(i, "A" if i < 600 else "B", "x" if i % 2 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "record_id long, category string, split string")
    targets = spark.createDataFrame([("A", 0.5, 1), ("B", 0.5, 1)], TARGETS)
    out = sample.target_sample(df, targets, "record_id", margins=("split",), fraction=0.25)
    got = {(r["margin"], r["value"]): r for r in out.margins.collect()}
    assert set(got) == {("category", "A"), ("category", "B"), ("split", "x"), ("split", None)}
    assert got["category", "A"]["pool_rows"] == 600 and got["category", "A"]["sampled_rows"] == 125 and got["category", "A"]["gap_rows"] == 0
    assert abs(got["split", "x"]["gap_rows"]) < 30 and sum(r["gap_rows"] for k, r in got.items() if k[0] == "split") == pytest.approx(0, abs=1e-6)


def test_minimums_are_repaired_after_the_draw(spark):
    rows = spark.createDataFrame([(i, "ABC"[i % 3] if i < 300 else "A") for i in range(600)], "record_id long, category string")
    targets = spark.createDataFrame([("A", 0.98, 1), ("B", 0.01, 10), ("C", 0.01, 20)], TARGETS)
    out = sample.target_sample(rows, targets, "record_id", fraction=0.5)
    assert {r["top_name"]: r["sampled_rows"] for r in out.report.collect()} == {"A": 270, "B": 10, "C": 20}
    plain = sample.target_sample(rows, spark.createDataFrame([("A", 0.98, 1), ("B", 0.01, 1), ("C", 0.01, 1)], TARGETS), "record_id", fraction=0.5)
    kept = lambda o, c: {r["record_id"] for r in o.rows.collect() if r["category"] == c}
    assert kept(plain, "B") < kept(out, "B") and kept(out, "A") < kept(plain, "A")


def test_raking_meets_both_margins():
    counts = np.array([100, 50, 30, 20])
    labels = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    fit = sample.rake(counts, labels, [np.array([40.0, 20.0]), np.array([40.0, 20.0])])
    assert np.allclose(np.bincount(labels[0], fit), [40, 20]) and np.allclose(np.bincount(labels[1], fit), [40, 20], atol=1e-6)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 50)), min_size=1, max_size=6), st.integers(0, 100))
def test_filling_never_passes_what_there_is(parts, total):
    w, most = np.array([a for a, _ in parts]), np.array([float(b) for _, b in parts])
    got = sample.fill_to(w * total, most, min(total, most.sum()))
    assert (got <= most + 1e-9).all() and got.sum() <= total * max(1, w.sum()) + 1e-6


def test_threshold_take_is_exact(spark):
    rows = spark.createDataFrame([("g" if i % 3 else "h", i, ((i * 37) % 101) / 101, 1) for i in range(300)], "g string, k long, r double, n int")
    quotas = spark.createDataFrame([("g", 17), ("h", 1000)], "g string, q long")
    got = take_by_threshold(rows, ["g"], "r", "k", "n", quotas, "q", bins=8).collect()
    best = sorted((r for r in rows.collect() if r["g"] == "g"), key=lambda r: (r["r"], r["k"]))[:17]
    assert {r["k"] for r in got if r["g"] == "g"} == {r["k"] for r in best}
    assert sum(r["g"] == "h" for r in got) == 100


# -- splitting ------------------------------------------------------------
def brute_cut(text, limit, overlap, slack):
    at, strength = split.boundaries(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    s = dict(zip(at.tolist(), strength.tolist(), strict=True))

    def best(low, high):
        inside = [p for p in range(low, high + 1) if p in s]
        return max(inside, key=lambda p: (s[p], p)) if inside else None

    out, start = [], 0
    while len(text) - start > limit:
        end = best(start + limit // 2, start + limit) or start + limit
        out.append((start, end))
        start = best(end - overlap - slack, end - overlap + slack) or end - overlap
    return [*out, (start, len(text))] if text else []


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\n-。é"), max_size=600))
def test_cuts_equal_brute_force(text):
    assert split.cut(text, 100, 20, 6) == brute_cut(text, 100, 20, 6)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=500))
def test_pieces_cover_the_text(text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    spans = split.cut(text, 60, 10, 4)
    assert all(b - a <= 60 for a, b in spans)
    whole = "".join(text[a if i == 0 else spans[i - 1][1] : b] for i, (a, b) in enumerate(spans))
    assert whole == text
    assert all(6 <= spans[i][1] - spans[i + 1][0] <= 14 for i in range(len(spans) - 1))


def test_split_operator(spark):
    long = "word and more. " * 200
    rows = spark.createDataFrame([(1, long, "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 1200, "x"), (5, "b" * 5000, "x"), (1, long, "x")], "row_id long, text string, piece_no string")
    out = split.split_oversized(rows, keep=("row_id",)).collect()
    assert {r["row_id"] for r in out} == {1, 5}
    one = [r for r in out if r["row_id"] == 1]
    assert len(one) == 2 * one[0]["n_pieces"] and all(r["piece_text"] == long[r["piece_start"] : r["piece_end"]] for r in one)
    assert split.split_oversized(rows.limit(0), keep=("row_id",)).count() == 0
    with pytest.raises(ValueError):
        split.cut("x", 100, 60, 10)


# -- mixing ---------------------------------------------------------------
def test_route_prefers_fewer_repeats():
    members = {("a",): (100, {"a": 100}), ("a", "b"): (50, {"a": 50, "b": 50})}
    got = mix.route(members, {"a": 100.0, "b": 60.0}, {"a": 2, "b": 3})
    assert sum(n for (_, s), n in got.items() if s == "b") == 60
    assert sum(n for (_, s), n in got.items() if s == "a") == 100
    assert got[("a",), "a"] == 100  # the shared text is used for b alone


def test_route_stops_at_the_cap():
    got = mix.route({("a",): (10, {"a": 10})}, {"a": 100.0}, {"a": 3})
    assert got == {(("a",), "a"): 30}


def test_mix(spark):
    docs = [(i, f"text number {i} of source a " * 3, "a") for i in range(60)] + [(100 + i, f"b {i}", "b") for i in range(5)] + [(200, None, "a"), (201, "", "b"), (202, "left out", None), (203, "left out", "z"), (100, "b 0", "b")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    out = mix.mix_sources(rows, targets, queries.RANKS)
    report = {r["source"]: r for r in out.report.collect()}
    assert not report["a"]["short"] and report["b"]["short"] and report["c"]["short"]
    assert report["b"]["selected_tokens"] == 2 * report["b"]["own_tokens"]
    assert report["a"]["selected_tokens"] <= report["a"]["wanted_tokens"] + 1
    assert report["a"]["wanted_tokens"] - report["a"]["selected_tokens"] < 30
    picked = out.rows.collect()
    assert all(r["repeats"] <= (1 if r["source"] == "a" else 2) for r in picked)
    assert {r["source"] for r in picked} == {"a", "b"}
    empty = mix.mix_sources(rows.limit(0), targets, queries.RANKS)
    assert empty.rows.count() == 0 and empty.report.count() == 3
