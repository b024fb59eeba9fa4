"""Queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import knn, leak, lookalike, mix, overlap, sample, spans, split, subjects


#: File of merge ranks of a public tokenizer.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _p1(spark: SparkSession, root: str) -> sample.Sampled:
    rows = sample.with_category(table(spark, root, "papers"), table(spark, root, "category_dim"))
    return sample.target_sample(rows, table(spark, root, "category_targets"), "record_id", margins=("split", "feed"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Categories whose pool cannot fill their target."""
    return _p1(spark, root).report.where("NOT met").select("top_name")


def p1_sample(spark: SparkSession, root: str) -> DataFrame:
    """The sample itself."""
    return _p1(spark, root).rows.select("record_id", "category")


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """Targets against what the sample holds."""
    return _p1(spark, root).report


def p1_size(spark: SparkSession, root: str) -> DataFrame:
    """Rows and different rows of the sample, and those of them without a category of the targets."""
    known = table(spark, root, "category_targets").select(F.col("top_name").alias("category"), F.lit(1).alias("_known"))
    rows = p1_sample(spark, root).join(F.broadcast(known), "category", "left")
    return rows.agg(F.count("*").alias("sampled"), F.countDistinct("record_id").alias("different"), F.sum(F.col("_known").isNull().cast("long")).alias("strangers"))


def p1_margins(spark: SparkSession, root: str) -> DataFrame:
    """Shares of every margin in the pool and the sample, with the gaps."""
    return _p1(spark, root).margins


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of every oversized chunk text."""
    return split.split_oversized(table(spark, root, "chunked_database"), keep=("row_id", "arxiv_id", "chunk_id"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows that came out in more than one piece."""
    return p2_pieces(spark, root).where("n_pieces > 1 AND piece_no = 0").select("row_id")


def p2_rejoined(spark: SparkSession, root: str) -> DataFrame:
    """Every cut text put together again from its pieces, and whether all pieces fit and overlap as they should."""
    p = p2_pieces(spark, root)
    parts = p.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "piece_text"))).alias("_p"), F.max(F.length("piece_text")).alias("_longest"))
    # from each piece what the one before it does not have
    ends = F.transform("_p", lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("_p"), i)["piece_end"] - x["piece_start"]))
    whole = F.array_join(F.zip_with("_p", "_e", lambda x, e: F.substring(x["piece_text"], e.cast("int") + 1, F.length(x["piece_text"]))), "")
    inside = F.forall(F.slice("_e", 2, F.size("_e")), lambda e: (e >= 160) & (e <= 240))
    return parts.withColumn("_e", ends).select("row_id", F.md5(whole).alias("digest"), (F.col("_longest") <= 1200).alias("fits"), inside.alias("overlaps"))


def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Train rows and val or test rows that are one record."""
    return overlap.cross_split_overlap(table(spark, root, "papers"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The same pairs, smaller id first."""
    return p3_pairs(spark, root).select(F.least("train_id", "eval_id").alias("record_id_a"), F.greatest("train_id", "eval_id").alias("record_id_b")).distinct()


def p3_links(spark: SparkSession, root: str) -> DataFrame:
    """Held-out papers with the number of train rows they overlap with."""
    return overlap.overlap_links(table(spark, root, "papers"))


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Counts per split and feed."""
    return overlap.overlap_report(p3_pairs(spark, root), table(spark, root, "papers"))


def p4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The 5 most similar vectors of every vector, with the papers and chunks of both."""
    rows = table(spark, root, "faiss_metadata")
    names = rows.select("vec_id", "arxiv_id", "chunk_id")
    found = knn.nearest(rows).join(names, "vec_id")
    other = names.select(F.col("vec_id").alias("neighbour"), F.col("arxiv_id").alias("neighbour_arxiv_id"), F.col("chunk_id").alias("neighbour_chunk_id"))
    return found.join(other, "neighbour")


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    """Neighbours and different neighbours of every vector, and how often it is its own."""
    n = knn.nearest(table(spark, root, "faiss_metadata"))
    return n.groupBy("vec_id").agg(F.count("*").alias("neighbours"), F.countDistinct("neighbour").alias("different"), F.sum((F.col("vec_id") == F.col("neighbour")).cast("long")).alias("own"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs among each other's 5 most similar, with a cosine of at least 0.85."""
    found = knn.nearest(table(spark, root, "faiss_metadata"), least=0.85)
    return found.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows of different papers with a common run of 200 characters."""
    return spans.sharing_pairs(table(spark, root, "chunked_database")).select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p5_spans(spark: SparkSession, root: str) -> DataFrame:
    """Stretches of each row that also stand in other papers."""
    return spans.shared_spans(table(spark, root, "chunked_database"))


def p5_shares(spark: SparkSession, root: str) -> DataFrame:
    """Share of each row's text that also stands in other papers."""
    return spans.shared_shares(table(spark, root, "chunked_database"))


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Rows joined by shared passages."""
    return spans.removal_clusters(table(spark, root, "chunked_database"))


def p5_near(spark: SparkSession, root: str) -> DataFrame:
    """Rows joined by texts that are nearly equal as a whole."""
    return spans.near_rows(table(spark, root, "chunked_database"))


def p6_texts(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk text in its common form."""
    return lookalike.one_form(table(spark, root, "chunked_database")).select("row_id", "canonical_text")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows that read the same but are stored differently."""
    return lookalike.same_reading(lookalike.one_form(table(spark, root, "chunked_database")))


def p6_classes(spark: SparkSession, root: str) -> DataFrame:
    """Rows by what they read as."""
    return lookalike.reading_classes(lookalike.one_form(table(spark, root, "chunked_database")))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the items that leaked into them."""
    return leak.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    """Documents by leaked item."""
    found = p7_found(spark, root).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, root, "eval_items").select("item_id", "suite", "split").join(found, "item_id")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources that fall short of their share however often they are repeated."""
    return _p8(spark, root).report.where("short").select("source")


def _p8(spark: SparkSession, root: str) -> mix.Mix:
    return mix.mix_sources(table(spark, root, "documents"), table(spark, root, "source_targets"), RANKS)


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """Documents of the mix with their repeats."""
    return _p8(spark, root).rows


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """Shares reached by source."""
    return _p8(spark, root).report


def p9_subjects(spark: SparkSession, root: str) -> DataFrame:
    """Subjects of every document, with the sentences counted."""
    return subjects.document_subjects(table(spark, root, "documents"), table(spark, root, "subject_examples"), table(spark, root, "subjects"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and their subjects."""
    return p9_subjects(spark, root).select("doc_id", "subject")


def p9_composition(spark: SparkSession, root: str) -> DataFrame:
    """The corpus by subject."""
    return subjects.composition(p9_found(spark, root), table(spark, root, "documents"), table(spark, root, "subjects"))


def queries() -> dict:
    """Every query of this folder by name."""
    here = globals()
    return {n: here[n] for n in sorted(here) if n[0] == "p" and n[1:2].isdigit()}
