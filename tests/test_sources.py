import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from textweft import schemas
from textweft.sources import files, jdbc, paged
from textweft.streaming import filedrop


def archive(**members):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, body in members.items():
            info = tarfile.TarInfo(name.replace("_", "."))
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return buf.getvalue()


def test_largest_tex():
    assert files.largest_tex(archive(a_tex=b"small", b_tex=b"larger one", c_png=b"x" * 99)) == b"larger one"
    assert files.largest_tex(archive(a_png=b"x")) is None
    assert files.largest_tex(gzip.compress(b"plain")) == b"plain"
    assert files.largest_tex(b"neither") is None and files.largest_tex(b"") is None


def test_document_texts_priority(spark):
    body = "word " * 25
    rows = spark.createDataFrame([("/q/a.TEX", b"\\textbf{one} % no\n"), ("/q/b.pdf", b"%PDF"), ("/q/c.txt", b" plain \n text \xff"), ("/q/d.pdf", b"%PDF"), ("/q/e.txt", b"fallback"), ("/q/f.txt", None)], "path string, content binary")
    archives = spark.createDataFrame([("/q/d.pdf", body), ("/q/e.txt", "too short")], "path string, latex string")
    got = {r["path"][-5]: (r["raw_text"], r["source_type"]) for r in files.document_texts(rows, archives, lambda b: "page\x01text").collect()}
    assert got["a"] == ("one  \n", "latex") and got["b"] == ("page text", "pdf") and got["c"] == ("plain text �", "unknown")
    assert got["d"][1] == "latex" and got["e"] == ("fallback", "unknown") and got["f"][0] is None
    without = {r["path"][-5]: r["raw_text"] for r in files.document_texts(rows).collect()}
    assert without["b"] is None


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    good = {"text": "t", "arxiv_id": "1", "title": "é", "chunk_id": 0}
    p.write_text(json.dumps(good) + "\n\n   \n" + json.dumps({**good, "source_type": "pdf"}) + "\n")
    assert sorted(r["source_type"] for r in files.chunk_lines(spark, str(p)).collect()) == ["pdf", "unknown"]
    p.write_text(json.dumps({"text": "t"}) + "\n")
    with pytest.raises(Exception, match="missing"):
        files.chunk_lines(spark, str(p)).collect()


def test_hierarchy_file(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text('{"cs":{"name":"Computer Science","subcategories":{"cs.LG":"Machine Learning"}},\n"quant-ph":{"name":"Quantum Physics"}}')
    got = {r["top_code"]: (r["top_name"], r["subs"]) for r in files.hierarchy(spark, str(p)).collect()}
    assert got == {"cs": ("Computer Science", {"cs.LG": "Machine Learning"}), "quant-ph": ("Quantum Physics", {})}


def test_write_split_and_read_one(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    files.write_split(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'test'").select("id").collect() == [(2,)]


def test_pages_stop():
    calls = []

    def fetch(cat, start, n):
        calls.append((start, n))
        return [{"i": k} for k in range(start, min(start + n, 7))]

    assert len(list(paged.pages(fetch, "c", 100, 3))) == 7 and calls == [(0, 3), (3, 3), (6, 3)]
    calls.clear()
    assert len(list(paged.pages(fetch, "c", 5, 3))) == 5 and calls == [(0, 3), (3, 2)]
    assert list(paged.pages(lambda *_: [], "c", 5, 3)) == []


def test_paged_data_source(spark):
    def fetch(cat, start, n):
        return [{"category": cat, "i": k} for k in range(start, min(start + n, 5))]

    spark.dataSource.register(paged.paged_source("pagedtest", "category string, i int", fetch))
    got = spark.read.format("pagedtest").options(categories="b, a", per_category=4, batch_size=3).load()
    assert got.groupBy("category").count().orderBy("category").collect() == [("a", 4), ("b", 4)]


def test_jdbc_address():
    assert jdbc.url("h", "d", "u", "p@ss/w").endswith("password=p%40ss%2Fw")


def test_filedrop_adds_a_document_once(spark, tmp_path):
    drop, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a b"), (2, None)], schema).write.parquet(drop)
    run = lambda: filedrop.write_once(filedrop.watch(spark, drop, schema), "doc_id", out, state, lambda d: d.withColumn("n", F.length("text")))
    run()
    spark.createDataFrame([(1, "again"), (3, "c")], schema).write.mode("append").parquet(drop)
    run()
    assert {(r["doc_id"], r["n"]) for r in spark.read.parquet(out).collect()} == {(1, 3), (2, None), (3, 1)}


def test_schemas_parse(spark):
    for ddl in (schemas.PAPER, schemas.CHUNK, schemas.VECTOR, schemas.USERS, schemas.UPLOADS, schemas.REPORTS):
        assert spark.createDataFrame([], ddl).count() == 0


def test_relational_tables(spark):
    address = "jdbc:derby:memory:weft;create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "id long, name string")
    jdbc.append_table(rows, address, "things", partitions=2)
    jdbc.append_table(rows.selectExpr("id + 40 AS id", "name"), address, "things")
    got = jdbc.read_table(spark, address, "things", "id", 0, 80, partitions=4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 80
    plan = got.where("id = 7").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(id), *EqualTo(id,7)]" in plan and got.where("id = 7").count() == 1
