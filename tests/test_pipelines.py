import argparse
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweft import __main__ as cli
from textweft import schemas
from textweft.operators import classify, embedding, index, registry
from textweft.plans import pipelines
from textweft.sources import files, paged
from textweft.streaming import filedrop


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b a a")], "embedding_ int, text string")
    got = {r["embedding_"]: r["embedding"] for r in embedding.embed(rows, "text", embedding.hashed_terms(16)).collect()}
    assert sum(got[1]) == 3 and got[1] == got[4] and got[1][embedding.bucket("a", 16)] >= 2 and sum(got[2]) == 0 and got[3] is None
    unit = {r["embedding_"]: r["embedding"] for r in embedding.embed(rows, "text", embedding.hashed_terms(16), unit=True).collect()}
    assert np.linalg.norm(unit[1]) == pytest.approx(1) and not any(unit[2])
    assert embedding.embed(rows.limit(0), "text", embedding.hashed_terms(4)).count() == 0


def test_any_model_can_be_plugged_in(spark):
    model = embedding.Embedder("text length", 2, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    rows = spark.createDataFrame([("p", "t", i, "x" * i, None) for i in range(1, 5)], schemas.CHUNK)
    built = index.build_index(rows, model, unit=False)
    assert [(r["vec_id"], r["embedding"], r["source_type"]) for r in built.orderBy("vec_id").collect()] == [(i - 1, [float(i), 1.0], "unknown") for i in range(1, 5)]
    asked = spark.createDataFrame([("q", 0, "xxx")], "doc string, chunk_id int, chunk_text string")
    best = index.search_index(built, asked, model, k=2).orderBy("rank").collect()
    assert [(r["q_doc"], r["chunk"]) for r in best] == [("q", 3), ("q", 4)]


def test_index_is_read_with_its_own_model(spark, tmp_path):
    rows = spark.createDataFrame([("p", "t", 0, "a b", "pdf")], schemas.CHUNK)
    model = embedding.hashed_terms(8)
    index.write_index(index.build_index(rows, model), model, str(tmp_path))
    assert index.read_index(spark, str(tmp_path), model).count() == 1
    with pytest.raises(ValueError, match="hashed-term-frequency-8"):
        index.read_index(spark, str(tmp_path), embedding.hashed_terms(16))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.read_index(spark, str(tmp_path / "absent"), model)


def test_paper_chunks_take_the_source_that_fits(spark):
    latex, page = "\\section{One} " + words(30), words(40, 100).encode()
    rows = [("1", "t", gzip.compress(latex.encode()), page), ("2", "t", gzip.compress(b"\\begin{document} too short"), page), ("3", "t", None, None), (" ", "t", None, page), ("4", None, b"no archive", page), ("5", "t", gzip.compress(b"short"), None)]
    df = spark.createDataFrame(rows, "arxiv_id string, title string, archive binary, pdf binary")
    got = {r["arxiv_id"]: (r["source_type"], r["text"].split()[0], r["title"]) for r in pipelines.paper_chunks(df, lambda b: b.decode()).collect()}
    assert got == {"1": ("latex", "one", "t"), "2": ("pdf", "w100", "t"), "4": ("pdf", "w100", "")}
    assert pipelines.paper_chunks(df).count() == 1 and pipelines.paper_chunks(df.limit(0)).count() == 0


def corpus_files(spark, tmp_path):
    texts = {"A": words(150), "B": words(150, 500), "C": words(60, 90)}
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()], "path string, content string").select("path", F.encode("content", "UTF-8").alias("content"))
    c = pipelines.query_chunks(rows)
    chunks = c.select(F.col("doc").alias("arxiv_id"), F.concat(F.lit("title "), "doc").alias("title"), "chunk_id", F.col("chunk_text").alias("text"), F.lit("pdf").alias("source_type"))
    pipelines.write_chunks(chunks, str(tmp_path / "chunks"))
    model = embedding.hashed_terms()
    index.write_index(index.build_index(spark.read.parquet(str(tmp_path / "chunks")), model), model, str(tmp_path / "index"))
    return texts


def test_command_line(spark, tmp_path, capsys):
    corpus_files(spark, tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "copy.txt").write_text(words(120))
    (tmp_path / "in" / "empty.txt").write_text("few words")
    base = ["--index", str(tmp_path / "index"), "--chunks", str(tmp_path / "chunks"), "--threshold", "0.6"]
    out = tmp_path / "made" / "report.json"
    cli.run(spark, cli.options().parse_args(["--input", str(tmp_path / "in" / "copy.txt"), "--output", str(out), "--pretty", *base]))
    r = json.loads(out.read_text())
    assert r["file_name"] == "copy.txt" and r["sources"][0]["arxiv_id"] == "A" and r["sources"][0]["title"] == "title A" and r["sources"][0]["has_exact_copies"] and r["global_plagiarism_score_percent"] > 90
    assert r["analysis_config"]["embedding_model"] == "hashed-term-frequency-256" and "\n  " in out.read_text()
    both = cli.run(spark, cli.options().parse_args(["--input", str(tmp_path / "in"), *base]))
    assert len(both) == 2 and [x for x in both if "error" in x] and json.loads(capsys.readouterr().out) == both
    (tmp_path / "source.gz").write_bytes(gzip.compress(words(120, 500).encode()))
    r = cli.run(spark, cli.options().parse_args(["--input", str(tmp_path / "in" / "copy.txt"), "--archive", str(tmp_path / "source.gz"), *base]))
    assert r[0]["sources"][0]["arxiv_id"] == "B"
    assert isinstance(cli.options(), argparse.ArgumentParser)


def test_classifier_from_texts(spark, tmp_path):
    rng = np.random.default_rng(1)
    topics = {"law": ["court", "judge", "appeal", "statute"], "sea": ["wave", "harbour", "tide", "sail"]}
    rows = [(" ".join(rng.choice(v, 12)), k) for k, v in topics.items() for _ in range(30)]
    train, val = (spark.createDataFrame(part, "text string, label string") for part in (rows[::2], rows[1::2]))
    model, report = pipelines.train_classifier(train, val, embedding.hashed_terms(32), hidden=(8,), iterations=60)
    assert {r["class"]: r["f1"] for r in report.collect()}["accuracy"] > 0.95
    classify.save(model, str(tmp_path / "m"), embedder="hashed-term-frequency-32", seed=42)
    again = classify.load(str(tmp_path / "m"))
    ready = embedding.embed(val, "text", embedding.hashed_terms(32))
    assert classify.predict(again, ready, "embedding").where("label = prediction").count() > 25
    assert spark.read.json(str(tmp_path / "m" / "about")).where("name = 'seed'").first()["value"] == "42"


def test_corpus_is_written_by_split(spark, tmp_path):
    tax = spark.createDataFrame([("a.X", "a", "Ay", "Ex")], "sub_code string, top_code string, top_name string, sub_name string")
    rows = spark.createDataFrame([(f" {i // 2} ", "a.X" if i < 40 else "?", [], i) for i in range(44)], "arxiv_id string, primary_category string, all_categories array<string>, n int")
    built = pipelines.corpus(rows, tax, [F.col("n")], most=15, least=5)
    pipelines.write_corpus(built, str(tmp_path))
    sizes = {n: spark.read.json(str(tmp_path / n)).count() for n in ("all", "train", "val", "test")}
    assert sizes == {"all": 15, "train": 12, "val": 1, "test": 2} and all(r["n"] % 2 == 0 for r in built.collect())


def test_filters_reach_the_paged_source(spark):
    asked = []

    class Probe(paged.paged_source("probe", "category string, i int", None).mro()[0]):
        pass

    reader = Probe({"categories": "a,b,c"}).reader(None)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([In(("category",), ("a", "c")), GreaterThan(("i",), 1)]))
    assert reader.codes == ["a", "c"] and len(rest) == 1
    assert list(reader.pushFilters([EqualTo(("category",), "c")])) == [] and [p.code for p in reader.partitions()] == ["c"] and asked == []


def test_profiles_with_several_addresses_make_one_user(spark):
    users = spark.createDataFrame([], schemas.USERS)
    p = spark.createDataFrame([("g", "b@x.y", "B", "B"), ("g", "a@x.y", "A", "A"), ("h", "h@x.y", None, None)], "google_id string, email string, given_name string, family_name string")
    got = [(r["id"], r["google_id"], r["email"], r["first_name"]) for r in registry.merge_accounts(users, p).orderBy("id").collect()]
    assert got == [(1, "g", "a@x.y", "A"), (2, "h", "h@x.y", None)]


def test_inserts(spark):
    users = spark.createDataFrame([(4, "A", "B", "a@x.y", None, None, None, True, None)], schemas.USERS)
    new = spark.createDataFrame([("a@x.y", "no"), ("b@x.y", "z"), ("b@x.y", "c"), (None, "n")], "email string, first_name string")
    got = [(r["id"], r["email"], r["first_name"], r["is_deleted"]) for r in registry.insert_users(users, new).orderBy("id").collect()]
    assert got == [(4, "a@x.y", "A", True), (5, "b@x.y", "c", False)] and registry.insert_users(users, new.limit(0)).count() == 1
    up = registry.insert_uploads(spark.createDataFrame([], schemas.UPLOADS), spark.createDataFrame([(1, "f.txt"), (1, None)], "user_id long, filename string"))
    assert [(r["id"], r["file_path"], r["status"]) for r in up.orderBy("id").collect()] == [(1, None, "PENDING"), (2, "uploads/f.txt", "PENDING")]
    drops = spark.createDataFrame([("f", 1, "old"), ("f", 2, "new"), ("g", 1, None)], "filename string, at int, content string")
    assert {(r["filename"], r["content"]) for r in registry.latest_files(drops, "at").collect()} == {("f", "new"), ("g", None)}
    reports = registry.insert_reports(spark.createDataFrame([], schemas.REPORTS), spark.createDataFrame([(1, 9, 0.5), (1, 8, 0.6), (7, 1, 0.1)], "document_id long, id long, global_score double"), up)
    assert [(r["id"], r["document_id"], r["global_score"]) for r in reports.collect()] == [(1, 1, 0.6)]


def test_batches_do_not_read_what_is_there(spark, tmp_path):
    drop, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id long, text string"
    for part in ([(1, "a"), (1, "a"), (None, "n")], [(1, "again"), (2, "b"), (None, "n")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(drop)
        filedrop.write_once(filedrop.watch(spark, drop, schema), "doc_id", out, state)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in spark.read.parquet(out).collect()) == [(0, "n"), (1, "a"), (2, "b")]


def test_missing_chunk_file_has_no_texts(spark, tmp_path):
    assert files.chunk_texts(spark, str(tmp_path / "absent")).count() == 0
