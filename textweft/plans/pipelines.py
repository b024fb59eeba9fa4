"""The pipelines end to end: corpus, chunks, index, analysis and classifier, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_extracted, collapse, cut_references, normalise, strip_structure, tokens
from ..operators import chunking, classify, index, labels, phrases, report
from ..operators.embedding import Embedder, embed
from ..session import checkpoint, stored
from ..sources import files


def corpus(records: DataFrame, taxonomy: DataFrame, order: list[Column], most: int = 400, least: int = 100, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Paper records with labels and a split: first of each id, mapped to the taxonomy, balanced by class, split by class.

    records: arxiv_id, primary_category, all_categories and more; blank ids are
    dropped.  taxonomy: sub_code, top_code, top_name, sub_name.
    """
    named = records.withColumn("arxiv_id", F.trim("arxiv_id")).where("arxiv_id <> ''")
    first = labels.first_wins(named, ["arxiv_id"], order)
    mapped = labels.map_labels(first, taxonomy, "arxiv_id", "primary_category", "all_categories")
    kept = labels.balance(mapped, "top_name", "arxiv_id", most, least, seed)
    return labels.stratified_split(kept, "top_name", "arxiv_id", train, val, seed)


def write_corpus(rows: DataFrame, path: str) -> None:
    """All records as JSON lines, and those of each split on their own."""
    rows = stored(rows)
    files.write_json_lines(rows.drop("split"), f"{path}/all")
    for name in ("train", "val", "test"):
        files.write_json_lines(rows.where(F.col("split") == name).drop("split"), f"{path}/{name}")


def paper_chunks(papers: DataFrame, extract_pdf: Callable[[bytes], str] | None = None, size: int = 100, overlap: int = 30, least: int = 20) -> DataFrame:
    """Chunk rows arxiv_id, title, chunk_id, text, source_type of papers (arxiv_id, title, archive, pdf).

    The source archive's text is taken if, without its structure, it has
    ``least`` words; else the PDF's; a paper with neither, or without an id, has
    no row.  Bytes are read once, in one narrow pass.
    """
    named = papers.where(F.trim("arxiv_id") != "").select(F.trim("arxiv_id").alias("arxiv_id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), "archive", "pdf")
    read = files.opened(named, "archive", "pdf", extract_pdf)
    latex, pdf = strip_structure(F.col("latex")), cut_references(clean_extracted(F.col("pdf_text")))
    fits = F.coalesce(F.size(tokens(collapse(latex))) >= least, F.lit(False))
    texts = read.select("arxiv_id", "title", normalise(F.when(fits, latex).otherwise(pdf)).alias("norm"), F.when(fits, "latex").otherwise("pdf").alias("source_type"))
    return chunking.chunks(texts, "norm", size, overlap, least).select("arxiv_id", "title", "chunk_id", F.col("chunk_text").alias("text"), "source_type")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and papers by the source they came from."""
    return chunks.groupBy("source_type").agg(F.count("*").alias("chunks"), F.countDistinct("arxiv_id").alias("papers"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table; a row's place is its (arxiv_id, chunk_id), not its position."""
    chunks.write.mode("overwrite").parquet(path)


def query_chunks(query_files: DataFrame, archives: DataFrame | None = None, extract_pdf: Callable[[bytes], str] | None = None, size: int = 100, overlap: int = 30, least: int = 20) -> DataFrame:
    """doc (the path), chunk_id, chunk_text, n_words of query files (path, content) by their best source."""
    texts = files.document_texts(query_files, archives, extract_pdf, least)
    return chunking.chunks(texts.select(F.col("path").alias("doc"), normalise(F.col("raw_text")).alias("norm")), "norm", size, overlap, least)


def analyze(query_files: DataFrame, vectors: DataFrame, chunks: DataFrame, embedder: Embedder, threshold: float = 0.85, k: int = 5, max_sources: int = 10, max_matches: int = 5, archives: DataFrame | None = None, extract_pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, report): the whole report, as JSON, on every query file (path, content) at once.

    vectors: an index; chunks: the chunk rows it was built from (arxiv_id,
    title, chunk_id, text, source_type).  Sources with a phrase of six words in
    common, found by the character matcher, are preferred.  Files without a
    chunk get an error report.
    """
    asked = stored(query_chunks(query_files.select("path", "content"), archives, extract_pdf))
    matches = checkpoint(report.scored(index.search_index(vectors, asked, embedder, k), threshold))
    texts = chunks.select(F.col("arxiv_id").alias("doc"), "chunk_id", F.coalesce("text", F.lit("Text not available.")).alias("chunk_text"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"), "title")
    top = report.top_matches(matches, max_matches)
    pairs = top.join(asked.select(F.col("doc").alias("q_doc"), F.col("chunk_id").alias("q_chunk"), F.col("chunk_text").alias("query_text")), ["q_doc", "q_chunk"])
    pairs = pairs.join(texts.select("doc", F.col("chunk_id").alias("chunk"), F.col("chunk_text").alias("db_text")), ["doc", "chunk"], "left")
    found = checkpoint(phrases.exact_phrases(pairs, "query_text", "db_text").withColumn("exact", F.size("phrases") > 0).drop("db_text"))
    ranked = report.rank_sources(found, report.first_seen(matches), "exact", max_sources)
    titles = texts.groupBy("doc").agg(F.coalesce(F.max("title"), F.lit("N/A")).alias("title"))
    names = query_files.select(F.col("path").alias("q_doc"), F.substring_index("path", "/", -1).alias("file_name"))
    out = report.report_documents(names, report.global_scores(matches, asked), ranked, found, texts, titles, threshold, embedder.name, max_sources, max_matches)
    return out.withColumnRenamed("q_doc", "path")


def train_classifier(train: DataFrame, val: DataFrame, embedder: Embedder, hidden: tuple[int, ...] = (256, 128), iterations: int = 500, seed: int = 42):
    """A category classifier of ``text`` rows with their ``label``, and its evaluation on ``val``: (model, report rows)."""
    ready = lambda d: embed(d.select("text", "label"), "text", embedder)
    model = classify.fit_classifier(stored(ready(train)), "embedding", "label", hidden, iterations, seed)
    return model, classify.evaluation(classify.predict(model, ready(val), "embedding"))
