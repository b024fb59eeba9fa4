"""From matches to ranked sources, scores and report documents, for any number of query documents at once.

Matches have q_doc, q_chunk, doc, chunk, cosine, rank; query chunks have doc,
chunk_id, chunk_text, n_words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import clamp, percent


def scored(matches: DataFrame, threshold: float) -> DataFrame:
    """Matches at or above the threshold after clamping, with the rounded score and percentage."""
    cos = clamp(F.col("cosine"))
    return matches.where(F.col("cosine").isNotNull()).withColumn("cosine", cos).where(F.col("cosine") >= threshold).withColumn("score", F.round("cosine", 4)).withColumn("match_percentage", percent(F.col("cosine")))


def flagged_chunks(matches: DataFrame) -> DataFrame:
    """q_doc, q_chunk, best: the best unrounded cosine of each flagged chunk."""
    return matches.groupBy("q_doc", "q_chunk").agg(F.max("cosine").alias("best"))


def global_scores(matches: DataFrame, query_chunks: DataFrame) -> DataFrame:
    """Per query document: words and chunks, flagged chunks, suspicious sources and the weighted score.

    Every chunk counts once, with its best match; words in overlaps count as
    often as they occur in chunks.  Documents without a match score 0.
    """
    size = query_chunks.groupBy(F.col("doc").alias("q_doc")).agg(F.sum("n_words").cast("long").alias("total_words"), F.count("*").alias("total_chunks"))
    hit = flagged_chunks(matches).join(query_chunks.select(F.col("doc").alias("q_doc"), F.col("chunk_id").alias("q_chunk"), "n_words"), ["q_doc", "q_chunk"])
    weight = hit.groupBy("q_doc").agg(F.sum(F.col("best") * F.col("n_words")).alias("_w"), F.count("*").alias("flagged"))
    sources = matches.groupBy("q_doc").agg(F.countDistinct("doc").alias("suspicious"))
    out = size.join(weight, "q_doc", "left").join(sources, "q_doc", "left")
    return out.select("q_doc", "total_words", "total_chunks", F.coalesce("flagged", F.lit(0)).alias("total_flagged_chunks"), F.coalesce("suspicious", F.lit(0)).alias("total_suspicious_sources"), F.round(F.coalesce(F.col("_w") / F.col("total_words") * 100, F.lit(0.0)), 2).alias("global_score"))


def top_matches(matches: DataFrame, most: int = 5) -> DataFrame:
    """The best ``most`` matches of each query document and source, by rounded score, then arrival."""
    w = Window.partitionBy("q_doc", "doc").orderBy(F.desc("score"), "q_chunk", "rank")
    return matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def rank_sources(matches: DataFrame, first_seen: DataFrame, exact: str, max_sources: int = 10) -> DataFrame:
    """Sources of each query document, ranked: q_doc, doc, match_count, average_similarity, has_exact, position.

    matches: truncated ones with a boolean column ``exact``.  If any source of
    a document has an exact match only those count; then more matches come
    first, and among equals the one seen first.
    """
    # means of hundredths in whole numbers, half up: the same on every engine
    cents, n = F.sum(F.round(F.col("match_percentage") * 100).cast("long")), F.count("*")
    by_source = matches.groupBy("q_doc", "doc").agg(n.alias("match_count"), (F.floor((cents * 2 + n) / (n * 2)) / 100).alias("average_similarity"), F.bool_or(exact).alias("has_exact"))
    prefer = by_source.withColumn("_any", F.max("has_exact").over(Window.partitionBy("q_doc"))).where("has_exact OR NOT _any").drop("_any")
    order = Window.partitionBy("q_doc").orderBy(F.desc("match_count"), "_first")
    return prefer.join(first_seen, ["q_doc", "doc"]).withColumn("position", F.row_number().over(order)).where(F.col("position") <= max_sources).drop("_first")


def first_seen(matches: DataFrame) -> DataFrame:
    """Where each source was met first, over all matches."""
    return matches.groupBy("q_doc", "doc").agg(F.min(F.struct("q_chunk", "rank")).alias("_first"))


def report_documents(names: DataFrame, scores: DataFrame, ranked: DataFrame, matches: DataFrame, texts: DataFrame, titles: DataFrame, threshold: float, embedder: str, max_sources: int = 10, max_matches: int = 5) -> DataFrame:
    """(q_doc, report): one nested report as JSON for each query document; documents without chunks get an error report.

    Lists inside a report hold at most max_sources x max_matches entries.
    """
    detail = (
        matches.join(texts.select(F.col("doc"), F.col("chunk_id").alias("chunk"), F.col("chunk_text").alias("db_text"), "source_type"), ["doc", "chunk"], "left")
        .groupBy("q_doc", "doc")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.col("q_chunk").alias("query_chunk_idx"), "query_text", F.col("chunk").alias("db_chunk_idx"), F.coalesce("db_text", F.lit("Text not available.")).alias("db_text"), F.col("score").alias("cosine_similarity"), "match_percentage", F.col("phrases").alias("exact_copied_phrases"), F.coalesce("source_type", F.lit("unknown")).alias("db_source_type")))).alias("_m"))
    )
    fields = [c for c in ("query_chunk_idx", "query_text", "db_chunk_idx", "db_text", "cosine_similarity", "match_percentage", "exact_copied_phrases", "db_source_type")]
    listed = (
        ranked.join(detail, ["q_doc", "doc"])
        .join(titles, "doc", "left")
        .groupBy("q_doc")
        .agg(F.count("*").alias("reported"), F.sort_array(F.collect_list(F.struct("position", F.col("doc").cast("string").alias("arxiv_id"), "title", "match_count", F.col("average_similarity").alias("average_similarity_percent"), F.col("has_exact").alias("has_exact_copies"), F.transform("_m", lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("matches")))).alias("_s"))
    )
    source_fields = ["arxiv_id", "title", "match_count", "average_similarity_percent", "has_exact_copies", "matches"]
    stats = F.struct(F.col("total_words"), F.col("total_chunks").alias("total_chunks_analyzed"))
    config = F.struct(F.lit(threshold).alias("threshold_used"), F.lit("Cosine Similarity").alias("metric"), F.lit(embedder).alias("embedding_model"), F.lit(max_sources).alias("max_sources_reported"), F.lit(max_matches).alias("max_matches_per_source"))
    body = F.struct(F.col("file_name"), stats.alias("document_stats"), config.alias("analysis_config"), F.col("global_score").alias("global_plagiarism_score_percent"), "total_suspicious_sources", F.coalesce("reported", F.lit(0)).alias("total_reported_sources"), "total_flagged_chunks", F.transform(F.coalesce("_s", F.array().cast(listed.schema["_s"].dataType)), lambda s: F.struct(*[s[f].alias(f) for f in source_fields])).alias("sources"))
    failure = F.to_json(F.struct(F.lit("No valid text could be extracted.").alias("error")))
    return names.join(scores, "q_doc", "left").join(listed, "q_doc", "left").select("q_doc", F.when(F.col("total_words").isNull(), failure).otherwise(F.to_json(body)).alias("report"))
