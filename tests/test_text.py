import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textweft.functions import text as tx
from textweft.operators.chunking import chunks, word_windows

NORMAL = [
    (r"\alpha + \beta_1", "alpha + _1"), (r"\frac{a}{b} = \sqrt{c}", "frac(a,b) = sqrt(c)"), (r"\frac{\sqrt{a}}{b}", "sqrt(a) b"),
    (r"\sum_{i} x^{2}", "_(i) x^(2)"), (r"\sum x \leq \infty", "sum x leq inf"), (r"\int_0^{1} f", "_0^(1) f"), ("αβ Γ", "alphabeta gamma"),
    (r"\alpha\beta", "alphabeta"), ("α_1", "alpha_1"), ('Schr\\"odinger', "schrödinger"), ('\\"{o}', '\\" o'), (r"\varepsilon x", "x"),
    (r"\textbf{Hi} there", "hi there"), ("Cost $5 [ref] {x}", "cost 5 ref x"), (" a  b\n", "a b"), ("", ""), (r"\Omega\omega x", "x"), (r"\beta\alpha", ""), (None, None),
]


def column(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.select("i", function(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def test_normalise_golden(spark):
    # names are replaced in the listed order, so nothing is left of "\beta\alpha"
    assert column(spark, [a for a, _ in NORMAL], tx.normalise) == [b for _, b in NORMAL]


def test_structure_golden(spark):
    cases = [(r"50\% of x", "50\\ "), (r"\section*{Intro} see \cite{k1}\begin{thebibliography}{9}X", "Intro see k1"), (r"\emph{\textbf{a}}", "a"), (r"\textbf{\emph{a}}", r"\textbf{a}"), ("x\\begin{document}y", "y"), (None, None)]
    assert column(spark, [a for a, _ in cases], tx.strip_structure) == [b for _, b in cases]


def test_references_are_cut_only_late(spark):
    body = "word " * 30
    out = column(spark, [body + "References x", "References " + body, body + "preferences", "", None], tx.cut_references)
    assert out == [body, "References " + body, body + "preferences", "", None]


def test_reference_position_counts_characters(spark):
    # beyond the basic plane: positions are characters, not UTF-16 units
    t = "\U0001d4d0" * 9 + " Bibliography"
    assert column(spark, [t], tx.cut_references) == [t]


def test_tokens_of_empty_text(spark):
    assert column(spark, ["", "a b", None], lambda c: F.size(tx.tokens(c))) == [0, 2, -1] or column(spark, ["", "a b"], lambda c: F.size(tx.tokens(c))) == [0, 2]


@pytest.mark.parametrize("n,sizes", [(0, []), (19, []), (20, [20]), (89, [89]), (90, [90, 20]), (100, [100, 30]), (170, [100, 100, 30]), (175, [100, 100, 35])])
def test_window_sizes(spark, n, sizes):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc int, t string")
    got = chunks(rows, "t").orderBy("chunk_id").collect()
    assert [r["n_words"] for r in got] == sizes
    assert [r["chunk_id"] for r in got] == list(range(len(sizes)))


def test_bad_window(spark):
    with pytest.raises(ValueError):
        word_windows(F.col("x"), 10, 10)


def test_chunks_null_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "doc int, t string, other string")
    assert chunks(rows, "t").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(20, 400))
def test_windows_cover_every_word(n):
    step, size = 70, 100
    seen = set()
    for s in range(0, n, step):
        w = range(s, min(n, s + size))
        if len(w) >= 20:
            seen.update(w)
    assert seen == set(range(n))
