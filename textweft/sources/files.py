"""Readers and writers for the file formats of the corpus pipeline."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import clean_extracted, collapse, cut_references, strip_structure, valid_utf8
from ..session import map_arrow


def json_lines(spark: SparkSession, path: str, schema, strict: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, malformed ones raise, and ``strict`` columns must be there."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in strict:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    return rows


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows for the vector index: text and identity are mandatory, the source type defaults to unknown."""
    return json_lines(spark, path, schemas.CHUNK, ("text", "arxiv_id", "title", "chunk_id")).withColumn("source_type", F.coalesce("source_type", F.lit("unknown")))


def chunk_texts(spark: SparkSession, path: str) -> DataFrame:
    """Only the texts of a chunk file; none if there is no file."""
    try:
        return json_lines(spark, path, "text string")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "text string")


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, top_code, top_name, subs) of a category file, one JSON object for all."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.HIERARCHY).alias("m"))
    return whole.select(F.posexplode("m").alias("ord", "top_code", "_v")).select(F.col("ord").cast("long").alias("ord"), "top_code", F.col("_v.name").alias("top_name"), F.coalesce("_v.subcategories", F.create_map().cast("map<string,string>")).alias("subs"))


ENTRY = "struct<id:string,title:string,summary:string,published:string,updated:string,primary_category:struct<_term:string>,category:array<struct<_term:string>>>"


def atom_entries(rows: DataFrame, xml: str) -> DataFrame:
    """Paper records of a column of Atom entries: id is what follows the last slash; categories are trimmed, empty ones dropped, each kept once in order."""
    e = rows.select(F.from_xml(xml, ENTRY, {"ignoreNamespace": "true"}).alias("e"))
    names = F.transform("e.category", lambda c: F.trim(c["_term"]))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return e.select(
        F.substring_index(F.trim(blank(F.col("e.id"))), "/", -1).alias("arxiv_id"),
        collapse(blank(F.col("e.title"))).alias("title"),
        collapse(blank(F.col("e.summary"))).alias("abstract"),
        F.trim(blank(F.col("e.published"))).alias("published"),
        F.trim(blank(F.col("e.updated"))).alias("updated"),
        F.trim(blank(F.col("e.primary_category._term"))).alias("primary_category"),
        F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != "")).alias("all_categories"),
    )


def largest_tex(content: bytes) -> bytes | None:
    """The largest .tex member of a tar archive (the first of equal ones), or a single gzipped text; None if there is neither."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            members = [m for m in tar.getmembers() if m.name.endswith(".tex") and m.isfile()]
            best = max(members, key=lambda m: m.size, default=None)
            return None if best is None else tar.extractfile(best).read()
    except tarfile.TarError:
        pass
    try:
        return gzip.decompress(content) or None
    except (OSError, EOFError, ValueError):
        return None


def archive_sources(files: DataFrame) -> DataFrame:
    """path and latex (text or null) of a binaryFile table of source archives."""
    return opened(files.select("path", "content"), "content").select("path", "latex")


def opened(rows: DataFrame, archive: str, pdf: str | None = None, extract_pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """The rows with latex, the text of the ``archive`` bytes, and pdf_text, what ``extract_pdf`` finds in the ``pdf`` bytes, in their place.

    Null where there are no bytes, nothing is found or, for PDFs, no extractor
    is given.  One narrow pass: bytes are neither shuffled nor joined back.
    """
    kept = [f for f in rows.schema.fields if f.name not in (archive, pdf)]
    schema = T.StructType([*kept, T.StructField("latex", T.StringType()), T.StructField("pdf_text", T.StringType())])
    bytes_of = [F.col(archive).alias("_archive"), (F.col(pdf) if pdf else F.lit(None).cast("binary")).alias("_pdf")]

    def run(batches):
        import pyarrow as pa

        from textweft.sources.files import largest_tex as pick

        for batch in batches:
            n = batch.num_columns - 2
            found = [c and pick(c) for c in batch.column(n).to_pylist()]
            pages = [extract_pdf(c) if c is not None and extract_pdf else None for c in batch.column(n + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([f.decode("utf-8", "replace") if f else None for f in found], pa.string()), pa.array(pages, pa.string())], names=schema.names)

    return map_arrow(rows.select(*[f.name for f in kept], *bytes_of), run, schema)


def document_texts(files: DataFrame, archives: DataFrame | None = None, extract_pdf: Callable[[bytes], str] | None = None, least: int = 20) -> DataFrame:
    """path, raw_text, source_type of query files by their best source.

    files: path, content.  archives: path, latex for files that come with an
    archive, used if it has ``least`` words; then a .tex file's own text, then
    what ``extract_pdf`` finds in a .pdf, then the file as text.  A .pdf without
    an extractor, or in which it finds nothing, has no text: its bytes are never
    read as text.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    base = files.select("path", suffix.alias("_suffix"), valid_utf8(F.col("content")).alias("_text"), F.when(suffix == ".pdf", F.col("content")).alias("_bytes"), F.lit(None).cast("binary").alias("_none"))
    base = (opened(base, "_none", "_bytes", extract_pdf) if extract_pdf else base.withColumn("pdf_text", F.lit(None).cast("string"))).drop("latex", "_bytes", "_none")
    # only texts meet in this join, not the files' bytes
    base = base.join(archives.select("path", "latex"), "path", "left") if archives is not None else base.withColumn("latex", F.lit(None).cast("string"))
    some = lambda c: F.when(F.trim(c) != "", c)
    archive = some(F.when(F.size(F.split(collapse(F.col("latex")), " ")) >= least, strip_structure(F.col("latex"))))
    tex = some(F.when(F.col("_suffix") == ".tex", strip_structure(F.col("_text"))))
    pdf = some(cut_references(clean_extracted(F.col("pdf_text"))))
    plain = some(F.when(F.col("_suffix") != ".pdf", collapse(F.col("_text"))))
    kind = F.when(archive.isNotNull() | tex.isNotNull(), "latex").when(pdf.isNotNull(), "pdf").otherwise("unknown")
    return base.select("path", F.coalesce(archive, tex, pdf, plain).alias("raw_text"), kind.alias("source_type"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Overwrite; non-ASCII text stays as it is."""
    rows.write.mode("overwrite").json(path)


def write_split(rows: DataFrame, path: str) -> None:
    """One Parquet folder a split, so that reading one reads nothing else."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document a line, as it is; other columns are left out."""
    reports.select("report").write.mode("overwrite").text(path)
