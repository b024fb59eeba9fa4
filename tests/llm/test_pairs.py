import inspect
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textweft.llm import graph, hnsw, knn, leak, lookalike, overlap, spans
from textweft.llm.glyphs import fold

RNG = np.random.default_rng(9)
VOCABULARY = [f"w{i:03d}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


# -- records across splits ------------------------------------------------
def test_paper_numbers(spark):
    ids = ["2203.100077v2", "arXiv:2203.100077", " /abs/2203.100077v1 ", "hep-th/9901001v3", "9901001", "", None, "draft"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, a string")
    got = [r[0] for r in rows.orderBy("i").select(overlap.paper_number(rows["a"])).collect()]
    assert got == ["2203.100077"] * 3 + ["9901001"] * 2 + [None, None, "draft"]


def test_overlap_equals_brute_force(spark):
    rows, rid = [], 0
    for i in range(60):
        base = prose(60).split()
        for s in ("train", "val", "test"):
            w = list(base)
            for _ in range(int(RNG.integers(0, 3))):  # edited stretches
                p = int(RNG.integers(0, 55))
                w[p : p + int(RNG.integers(1, 5))] = [str(x) for x in RNG.choice(VOCABULARY, 2)]
            rows.append((rid, f"{1000 + rid}.{i:05d}", " ".join(w).upper() if rid % 2 else " ".join(w), s, "x"))
            rid += 1
    rows += [(900, "1.1", None, "train", "x"), (901, "arXiv:1.1v2", "", "val", "x"), (902, "7.7", "  --  ", "test", "x"), (903, None, None, None, None), (904, None, rows[0][2], "val", "y"), (905, None, rows[0][2], "train", "y")]
    df = spark.createDataFrame(rows, "record_id long, arxiv_id string, abstract string, split string, _c string")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_overlap(df).collect()}
    sets = {r[0]: set(re.findall("[a-z0-9]+", (r[2] or "").lower())) for r in rows}
    want = {(900, 901)}
    for a in rows:
        for b in rows:
            if a[3] == "train" and b[3] in ("val", "test") and sets[a[0]] and sets[b[0]] and len(sets[a[0]] & sets[b[0]]) / len(sets[a[0]] | sets[b[0]]) >= 0.7:
                want.add((a[0], b[0]))
    assert got == want
    report = overlap.overlap_report(overlap.cross_split_overlap(df), df, feed="_c").collect()
    assert sum(r["pairs"] for r in report) == len(want)
    assert overlap.cross_split_overlap(df.limit(0)).count() == 0


def test_overlap_finds_pairs_without_a_common_chunk(spark):
    rows, want = [], set()
    for i in range(30):
        n = int(RNG.integers(75, 141))
        base = [f"{'c' if j % 3 else 'r'}{j if j % 3 else 1000 * i + j}" for j in range(n)]
        edits = int(n * 0.3 / 1.7)
        even = list(base)
        for j in np.linspace(0, n - 1, edits).astype(int):  # single words all over, just above 0.7
            even[j] = f"e{i}x{j}"
        rows += [(4 * i, base, "train"), (4 * i + 1, even, "val"), (4 * i + 2, base[::-1], "test"), (4 * i + 3, base[: n // 2], "test")]
    rows += [(900, ["one"], "train"), (901, ["one", "one"], "val"), (902, ["b", "a"], "train"), (903, ["a", "b", "a"], "val")]
    for a, x, s in rows:
        for b, y, t in rows:
            if s == "train" and t != "train" and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.7:
                want.add((a, b))
    df = spark.createDataFrame([(k, None, " ".join(w), s) for k, w, s in rows], "record_id long, arxiv_id string, abstract string, split string")
    assert len(want) >= 62
    assert {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_overlap(df).collect()} == want


def edited(kind, base, rng, i):
    w = list(base)
    if kind == "one word in six":
        for j in range(0, len(w), 6):
            w[j] = f"n{i}x{j}"
    elif kind == "neighbours swapped":
        for j in range(0, len(w) - 1, 2):
            w[j], w[j + 1] = w[j + 1], w[j]
    elif kind == "words at random":
        for j in rng.choice(len(w), int(len(w) * 0.17), replace=False):
            w[j] = f"n{i}x{j}"
    elif kind == "sentences reordered":
        parts = [w[a : a + 12] for a in range(0, len(w), 12)]
        w = [x for p in rng.permutation(len(parts)) for x in parts[p]]
    elif kind == "a quarter cut off":
        w = w[: int(len(w) * 0.75)]
    return w


@pytest.mark.parametrize("kind", ["one word in six", "neighbours swapped", "words at random", "sentences reordered", "a quarter cut off"])
def test_overlap_finds_every_kind_of_edit(spark, kind):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(100):
        base = [f"w{int(x)}" for x in rng.permutation(4000)[: int(rng.integers(40, 140))]]
        rows += [(2 * i, " ".join(base), "train"), (2 * i + 1, " ".join(edited(kind, base, rng, i)), "test")]
    sets = {k: set(t.split()) for k, t, _ in rows}
    want = {(k, k + 1) for k in range(0, 200, 2) if len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) >= 0.7}
    df = spark.createDataFrame([(k, None, t, s) for k, t, s in rows], "record_id long, arxiv_id string, abstract string, split string")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_overlap(df).collect()}
    assert len(want) > 90 and got <= want and len(got) >= (0.97 if "swap" not in kind and "reordered" not in kind else 1.0) * len(want)


def test_chunks_meet_at_the_threshold():
    rng = np.random.default_rng(2)
    for n in (36, 60, 80, 150):
        met = 0
        for _ in range(300):
            both = int(np.ceil(2 * n * 0.7 / 1.7 - 1e-9))
            h = rng.integers(1, 2**62, 2 * n - both).astype(np.uint64)
            a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:both], h[n:]]))
            met += any(set(overlap.chunk_digests(a, np.array([0]), 2, 3, 8, k)[1]) & set(overlap.chunk_digests(b, np.array([0]), 2, 3, 8, k)[1]) for k in range(overlap.cutters_for(n)))
        assert met >= 0.99 * 300


def test_short_records_miss_none(spark):
    bases = [RNG.permutation(60)[: int(RNG.integers(1, 33))] for _ in range(40)]
    sets = {i: np.unique(np.append(RNG.permutation(bases[i // 4])[int(RNG.integers(0, 3)) :], RNG.integers(0, 60, int(RNG.integers(0, 3))))) for i in range(160)}
    sets = {i: s for i, s in sets.items() if len(s)}
    rows = [(i, None, " ".join(f"v{w}" for w in RNG.permutation(s)), "train" if i % 3 else "val") for i, s in sets.items()]
    df = spark.createDataFrame(rows, "record_id long, arxiv_id string, abstract string, split string")
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a % 3 and b % 3 == 0 and min(len(x), len(y)) <= 24 and len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.7}
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_overlap(df).collect()}
    assert len(want) > 50 and want <= got


def test_hot_digests_are_spread(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 5)
    base = [f"t{j}" for j in range(40)]
    rows = [(i, None, " ".join([*base, f"a{i}", f"b{i}"]), "train" if i % 3 else "val") for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, arxiv_id string, abstract string, split string")
    assert overlap.cross_split_overlap(df).count() == 40 * 20


# -- vectors --------------------------------------------------------------
def cloud(n, width=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(x, found, picked):
    s = x[picked] @ x.T
    s[np.arange(len(picked)), picked] = -2
    true = np.argsort(-s, axis=1)[:, :5]
    return np.mean([len((set(found[q]) - {q}) & set(t)) / 5 for q, t in zip(picked, true, strict=True)])


def test_graph_recall_with_production_values():
    x, picked = cloud(6000), np.arange(0, 6000, 12)
    values = inspect.signature(knn.nearest).parameters
    g = hnsw.Hierarchy(x, build=values["build"].default)
    assert len(g.layers) == 3
    assert recall(x, g.neighbours()[0], picked) > 0.97
    assert recall(x, g.query(x, 6, values["ef"].default)[0], picked) > 0.97


@pytest.mark.parametrize("n", [0, 1, 5, 40, 256, 257, 3000])
def test_graph_of_any_size(n):
    x = cloud(n, 8)
    g = hnsw.Hierarchy(x)
    ids, sims = g.neighbours()
    assert ids.shape == (n, 6) and not (ids == np.arange(n)[:, None]).any() and ((ids >= 0).sum(1) == min(6, max(0, n - 1))).all()
    assert (np.diff(sims, axis=1) <= 0).all() and all(len(set(r) - {-1}) == (r >= 0).sum() for r in ids)
    found, _ = g.query(x[:3], 4)
    assert n == 0 or (found[:, 0] == np.arange(min(3, n))).all()


def test_guests_count_for_both_sides():
    x = cloud(900, 16)
    g = hnsw.Hierarchy(x[:600])
    g.query(x[600:], 6, 32, names=np.arange(600, 900))
    assert recall(x, g.neighbours()[0], np.arange(0, 600, 3)) > 0.95


def test_large_cells_are_halved():
    x = np.concatenate([cloud(2000, 16) * 0.1 + np.eye(16)[0], cloud(100, 16)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = knn.centroids(x, 3, 300)
    assert len(c) > 6 and np.isfinite(c).all()
    assert len(knn.centroids(np.repeat(x[:1], 50, 0), 2, 10)) >= 1


def test_vectors_over_many_shards(spark):
    x = cloud(3000, 16)
    got = knn.nearest(vectors(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)]), width=16, shard_rows=250).collect()
    found = np.full((3000, 5), -1)
    for r in got:
        found[r["vec_id"], r["rank"] - 1] = r["neighbour"]
    assert len(got) == 15000 and recall(x, found, np.arange(0, 3000, 10)) > 0.75


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_nearest_equals_brute_force(spark):
    x = RNG.normal(size=(150, 8))
    x[10:20] = x[3]  # a group of copies larger than a list
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, []), (203, [float("nan")] * 8), (204, [1.0, None] + [0.0] * 6)]
    got = {}
    for r in knn.nearest(vectors(spark, rows), width=8, shard_rows=60, probes=99).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour"]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert set(got) == set(range(150))
    for i in range(150):
        want = sorted(range(150), key=lambda j: (-round(s[i, j], 5), j))[:5]
        assert [got[i][k] for k in sorted(got[i])] == want


def test_nearest_of_nothing_and_one(spark):
    assert knn.nearest(vectors(spark, []), width=2).count() == 0
    assert knn.nearest(vectors(spark, [(1, [1.0, 0.0])]), width=2).count() == 0
    assert knn.nearest(vectors(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0])]), width=2).select("vec_id", "neighbour").collect() in ([(1, 2), (2, 1)], [(2, 1), (1, 2)])


def test_rows_without_a_key_are_no_neighbours(spark):
    rows = [(1, [1.0, 2.0]), (None, [1.0, 1.9]), (2, [1.0, 0.5])]
    assert {(r["vec_id"], r["neighbour"]) for r in knn.nearest(vectors(spark, rows), width=2).collect()} == {(1, 2), (2, 1)}


def test_odd_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = "lorem ipsum dolor sit amet " * 20000
    texts = [None, "", " ", long, long + "more", "ﬁne 😀 \u200b Ιater", "a", "same text here", "same text here", "x" * 3000]
    rows = [(i if i != 8 else 7, f"p{i}.{i}v1" if i != 6 else None, t, ["train", "val", None, "test"][i % 4]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id long, arxiv_id string, text string, split string")
    for name in ("_k", "_c", "_b", "_d", "_i", "_x", "_n", "_text", "_paper", "word", "band", "a", "b"):
        df = df.withColumn(name, F.lit("clash"))
    assert {tuple(r) for r in overlap.cross_split_overlap(df, key="row_id", text="text").select("train_id", "eval_id").collect()} >= {(4, 3)}
    assert [tuple(r) for r in spans.sharing_pairs(df, longest=True).collect()] == [(3, 4, 0, 0, len(long))]
    near = {r["row_id"]: (r["cluster_id"], r["links"]) for r in spans.near_rows(df).collect()}
    assert set(near) == {3, 4, 5, 6, 7, 9} and near[3] == near[4] == (3, 1) and near[7] == (7, 0)
    assert lookalike.one_form(df).count() == len(rows) and spans.shared_shares(df).count() == len(rows)
    assert leak.leaks(df.withColumnRenamed("row_id", "doc_id"), spark.createDataFrame([(1, "lorem ipsum dolor sit amet"), (2, None), (3, "")], "item_id long, text string")).count() == 2


def test_split_cells_find_all(spark):
    # one cell holds nearly everything and is split; its parts must be asked together
    x = np.concatenate([RNG.normal(size=(120, 4)) * 0.05 + [1, 0, 0, 0], [[0, 0, 0, 1.0]]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = knn.nearest(vectors(spark, rows), width=4, shard_rows=20, probes=99).collect()
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert np.mean([r["cosine"] >= np.sort(s[r["vec_id"]])[-5] - 1e-5 for r in got]) > 0.99


# -- long passages --------------------------------------------------------
def chunk_table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, arxiv_id string, text string")


def passages():
    shared = prose(60)
    rows = [(i, f"1.{i}v1", prose(80)) for i in range(20)]
    rows += [(30, "2.1v1", prose(30) + " " + shared + " " + prose(20)), (31, "2.2v1", prose(5) + " " + shared), (32, "2.2v3", shared + prose(9)), (33, None, shared), (34, "2.4", shared[:199]), (35, "2.5", None), (36, "2.6", ""), (37, "2.7", "x" + shared[:200] + "y"), (38, "2.8", shared[50:250])]
    rows += [(40, "3.1", "ab" * 300), (41, "3.2", "ab" * 150), (40, "3.1", "ab" * 300)]
    return rows


def brute_pairs(rows, run=200):
    out = set()
    for a, pa, ta in rows:
        for b, pb, tb in rows:
            if a < b and ta and tb and pa and pb and re.sub(r"v\d+$", "", pa) != re.sub(r"v\d+$", "", pb):
                grams = {ta[i : i + run] for i in range(len(ta) - run + 1)}
                if any(tb[i : i + run] in grams for i in range(len(tb) - run + 1)):
                    out.add((a, b))
    return out


def test_passages_equal_brute_force(spark):
    rows = passages()
    assert {tuple(r) for r in spans.sharing_pairs(chunk_table(spark, rows)).collect()} == brute_pairs(rows)
    got = spans.sharing_pairs(chunk_table(spark, rows), longest=True).collect()
    assert {(r["a"], r["b"]) for r in got} == brute_pairs(rows)
    text = {k: t for k, _, t in rows}
    for r in got:
        assert text[r["a"]][r["start_a"] : r["start_a"] + r["length"]] == text[r["b"]][r["start_b"] : r["start_b"] + r["length"]]


def test_paragraphs_that_are_merely_alike_do_not_meet(spark):
    base = prose(150)
    # one frame of words, another number every 60 characters
    rows = [(i, f"1.{i}v1", "".join(f"{base[j : j + 60]} {i:03d} " for j in range(0, 600, 60))) for i in range(60)]
    rows += [(100, "2.1", rows[7][2][40:300])]
    parts = spans.paragraphs(spans.prepare(chunk_table(spark, rows), "row_id", "arxiv_id", "text", 200), 200, 100, once=True)
    assert {r["_k"] for r in spans.meeting(parts).select("_k").distinct().collect()} == {7, 100}
    assert {tuple(r) for r in spans.sharing_pairs(chunk_table(spark, rows)).collect()} == brute_pairs(rows) == {(7, 100)}


def test_copies_are_compared_once(spark, monkeypatch):
    shared = prose(60)
    x, y = prose(20) + " " + shared, shared + " " + prose(30)
    rows = [(i, f"1.{i}v1", (x, y)[i % 2]) for i in range(20)]
    compared, map_arrow = [], spans.map_arrow

    def counted(df, *args):
        if "ta" in df.columns:
            compared.append(df.count())
        return map_arrow(df, *args)

    monkeypatch.setattr(spans, "map_arrow", counted)
    assert {tuple(r) for r in spans.sharing_pairs(chunk_table(spark, rows)).collect()} == brute_pairs(rows)
    assert len(brute_pairs(rows)) == 190 and compared == [4]


def test_shares_equal_brute_force(spark):
    rows = passages()[:-1]
    got = {r["row_id"]: r["shared_chars"] for r in spans.shared_shares(chunk_table(spark, rows)).collect()}
    for a, pa, ta in rows:
        hit = set()
        if pa and ta:
            others = {tb[i : i + 200] for b, pb, tb in rows if pb and tb and re.sub(r"v\d+$", "", pb) != re.sub(r"v\d+$", "", pa) for i in range(len(tb) - 199)}
            for i in range(len(ta) - 199):
                if ta[i : i + 200] in others:
                    hit.update(range(i, i + 200))
        assert got[a] == len(hit), a
    clusters = {r["row_id"]: r["cluster_id"] for r in spans.removal_clusters(chunk_table(spark, rows)).collect()}
    assert clusters[30] == clusters[31] == clusters[32] == clusters[37] and clusters[40] == clusters[41] != clusters[30]
    assert spans.shared_shares(chunk_table(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abc", max_size=40), st.integers(1, 6))
def test_longest_run(a, b, run):
    best = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(run, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=None)
    assert spans.longest_run(a, b, run) == (best and (-best[1], -best[2], best[0]))
    found = spans.common_run(a, b, run)
    assert (found is None) == (best is None) and (found is None or a[found[0] : found[0] + run] == b[found[1] : found[1] + run])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=60), st.text(alphabet="ab", min_size=1, max_size=60), st.data())
def test_reach(a, b, data):
    i, j = data.draw(st.integers(0, len(a) - 1)), data.draw(st.integers(0, len(b) - 1))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    back = 0
    while n and back < min(i, j) and a[i - back - 1] == b[j - back - 1]:
        back += 1
    assert spans.reach(a, b, i, j) == n + back


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == got[102] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- look-alikes ----------------------------------------------------------
def test_folding():
    same = ["café au lait - fine", "cafe\u0301 au\u00a0lait \u2011 ﬁne", "ｃａｆé\u200b au  lait\n- fine", "сафе\u0301 au lait - f\u00adine".replace("ф", "f")]
    assert {fold(t) for t in same} == {"café au lait - fine"}
    assert len({fold(t) for t in ["cafe", "café", "Cafe", "cafe2", "x²", "x2", "naïve", "naive"]}) == 8
    assert fold("") == "" and fold(" \u200b ") == ""


def test_automaton():
    trie = lookalike.Trie([("fine", 3), ("café", 1), ("fin", 9), ("later", 5), ("In", 4), ("ln", 50), ("analysis", 2)])
    assert trie.search("ﬁne") == ("fine", 0.0) and trie.search("f\u200bіnе") == ("fine", 0.0)
    assert trie.search("cafe\u0301") == ("café", 0.0) and trie.search("cafe") is None and trie.search("fime") is None and trie.search("") is None
    # a capital iota is an I, and an l where only that makes a word
    assert trie.search("Ιater") == ("later", lookalike.DOUBT) and trie.search("Ιn") == ("In", 0.0)
    assert trie.search("αnαlysιs") is None and trie.search("αnαlysis") == ("analysis", 2 * lookalike.DOUBT) and trie.search("Ιn", 0.0) == ("In", 0.0)


def test_the_vocabulary_decides_where_the_table_cannot(spark):
    rows = [(1, "see you later"), (2, "see you Ιater"), (3, "αnalysis of it"), (4, "analysis of it"), (5, "α is a letter"), (6, "a is a letter"), (7, "In fact"), (8, "Ιn fact"), (9, "zzιzz"), (10, "http/Ιater?x"), (11, "http/later?x")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    assert fold("Ιater") == "Iater" and fold("αnalysis") == "αnalysis"  # what the table alone makes of them
    pairs = {tuple(r) for r in lookalike.same_reading(lookalike.one_form(df)).collect()}
    assert pairs == {(1, 2), (3, 4), (7, 8), (10, 11)}
    many = {tuple(r) for r in lookalike.canonical_words(df, "text", trie_words=1).collect()}
    assert many == {tuple(r) for r in lookalike.canonical_words(df, "text").collect()} and ("Ιater", "later", True) in many


def test_one_form(spark):
    rows = [(1, "the ﬁne café", "k"), (2, "the fine cafe\u0301", "k"), (3, "the fine cafe", "k"), (4, None, "k"), (5, " ", "k"), (6, "the\u2009fine café", "k"), (6, "the fine café", "k"), (7, "zzз\u200b unique", "k"), (None, "ﬁ", "k"), (8, "\u200b", "k")]
    df = spark.createDataFrame(rows, "row_id long, text string, word string")
    got = [(r["row_id"], r["canonical_text"]) for r in lookalike.one_form(df, keep=("word",)).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == by[2] == by[6] == "the fine café" and by[3] == "the fine cafe" and by[4] is None and by[5] == "" and by[None] == "fi" and by[8] == ""
    pairs = {(r["row_id_a"], r["row_id_b"]) for r in lookalike.same_reading(lookalike.one_form(df)).collect()}
    assert pairs == {(1, 2), (1, 6), (2, 6)}
    classes = {r["row_id"]: r["class_id"] for r in lookalike.reading_classes(lookalike.one_form(df)).collect()}
    assert classes[1] == classes[2] == 1 and classes[3] == 3
    assert lookalike.one_form(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoIlаеоｆﬁΙα\u0301\u200b é- \u00a0.２"), max_size=14))
def test_words_keep_what_can_be_seen(text):
    for word, part in lookalike.segments(text):
        if word and fold(part):
            # every spelling that may match is met, and without a doubtful reading it is the table's
            assert lookalike.Trie([(fold(part), 1)]).search(part) == (fold(part), 0.0)
            hit = lookalike.Trie([(lookalike.skeleton(part), 1)]).search(part)
            assert hit is None or lookalike.skeleton(hit[0]) == lookalike.skeleton(part)
    whole = "".join(fold(p) if looked_up else p for t in text.split() for looked_up, p in [*lookalike.pieces(t), (False, " ")])
    assert " ".join(whole.split()) == fold(text)


# -- leaks ----------------------------------------------------------------
def test_page_words():
    assert leak.words_of("<i>The</i> \\emph{quick} exam-\nple, *well-known* “сode” \\cite{x9} 3.5") == ["the", "quick", "example", "wellknown", "code", "3", "5"]
    assert leak.words_of(None) == leak.words_of(" ") == []


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, w in enumerate(p, 1):
        new = [i]
        for j, v in enumerate(t, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=25), st.integers(0, 6))
def test_best_distance(p, t, most):
    assert leak.best_distance(p, t, most) == (edit_distance(p, t) <= most)


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    items = [(i, prose(int(n), rng)) for i, n in enumerate([3, 8, 12, 20, 25, 40, 70, 110, 200])] + [(50, None), (51, "..."), (52, "one")]
    docs = []
    for d in range(80):
        i = int(rng.integers(0, 9))
        w = items[i][1].split()
        kind = d % 4
        if kind == 1:
            a = int(rng.integers(0, max(1, len(w) - 11)))
            w = w[a : a + int(rng.integers(10, 14))]
        elif kind == 2:
            for p in rng.choice(len(w), int(len(w) * rng.uniform(0.1, 0.3)), replace=False):
                w[p] = ["", "new", w[p] + " extra"][int(rng.integers(0, 3))]
        elif kind == 3:
            w = []
        docs.append((d, prose(int(rng.integers(0, 150)), rng) + " " + " ".join(w).upper() + ", " + prose(int(rng.integers(0, 150)), rng)))
    docs += [(900, None), (901, ""), (902, items[4][1]), (902, items[4][1])]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leak.leaks(a, b).collect()}
    want = set()
    for d, t in docs:
        w = leak.words_of(t)
        for i, x in items:
            p = leak.words_of(x)
            if not p:
                continue
            n = min(12, len(p))
            runs = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)) or len(p) >= 20 and edit_distance(p, w) <= len(p) // 4:
                want.add((d, i))
    assert got - want == set()
    assert len(want - got) <= 0.02 * len(want)
    assert leak.leaks(a.limit(0), b).count() == 0 and leak.leaks(a, b.limit(0)).count() == 0


def test_bands():
    assert leak.bands_for(0.5, 0.99) == 7
    with pytest.raises(ZeroDivisionError):
        leak.bands_for(0.0, 0.9)


def test_sparse_members():
    m = leak.Members([[1, 5], [], [0, 9]], 10)
    assert m.has(np.array([0, 0, 1, 2, 2]), np.array([1, 2, 5, 9, 1])).tolist() == [True, False, False, True, False]
    assert leak.Members([], 3).has(np.array([0]), np.array([0])).tolist() == [False]


def test_leaks_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    items = [(i, prose(30, rng)) for i in range(9)]
    docs = [(i, prose(40, rng) + " " + items[i % 9][1] + " " + prose(20, rng)) for i in range(18)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leak.leaks(a, b).collect()}
    monkeypatch.setattr(leak, "BLOCK", 4)
    assert {tuple(r) for r in leak.leaks(a, b).collect()} == whole == {(i, i % 9) for i in range(18)}
    monkeypatch.setattr(leak, "BLOCK_WORDS", 50)
    assert {tuple(r) for r in leak.leaks(a, b).collect()} == whole


def test_near_rows_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(40):
        w = prose(int(rng.integers(20, 90)), rng).split()
        for k in range(4):
            v = list(w)
            for p in rng.choice(len(v), int(rng.integers(0, 3)), replace=False):
                v[p] = f"new{i}{k}"
            rows.append((4 * i + k, "  ".join(v).upper() if k == 1 else " ".join(v)))
    rows += [(900, None), (901, " "), (902, "two words"), (903, "Two  words"), (904, "two words more"), (0, rows[0][1])]

    def runs(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    texts = {" ".join(t.lower().split()): runs(t) for _, t in rows if t and t.strip()}
    links = {a: {b for b in texts if b != a and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])} for a in texts}
    low = {}
    for k, t in rows:
        if t and t.strip():
            low[" ".join(t.lower().split())] = min(k, low.get(" ".join(t.lower().split()), k))
    cluster = dict(low)
    for _ in range(10):
        for a in texts:
            for b in links[a]:
                cluster[a] = cluster[b] = min(cluster[a], cluster[b])
    want = sorted((k, cluster[" ".join(t.lower().split())], len(links[" ".join(t.lower().split())])) for k, t in rows if t and t.strip())
    df = spark.createDataFrame(rows, "row_id long, text string")
    assert sum(n > 0 for *_, n in want) > 60
    assert sorted(tuple(r) for r in spans.near_rows(df).collect()) == want
    monkeypatch.setattr(spans, "HOT", 2)
    assert sorted(tuple(r) for r in spans.near_rows(df).collect()) == want
    assert spans.near_rows(df.limit(0)).count() == 0


def test_bands_meet_at_the_threshold():
    # recall as tuned: bands of four for 0.8
    assert leak.bands_for(0.8**4, 0.9999) == 18


def test_links_count_without_pairs(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(i, f"1.{i}", a, "train") for i in range(30)] + [(40, "1.40", a + " more", "train"), (50, "9.1", a, "val"), (51, "9.2v2", a, "test"), (52, "arXiv:1.3v9", b, "test"), (53, "9.4", b, "val"), (54, "1.5", None, "val"), (55, None, "..", "val"), (56, "1.5", a, None)]
    df = spark.createDataFrame(rows, "record_id long, arxiv_id string, abstract string, split string")
    got = {tuple(r) for r in overlap.overlap_links(df).collect()}
    assert got == {(50, 50, 31, 0), (51, 50, 31, 0), (52, 52, 0, 1), (54, 54, 0, 1)}
    assert overlap.overlap_links(df.limit(0)).count() == 0
