"""The vector index: chunk rows with their vectors, as one table that is searched exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import numbered
from .embedding import Embedder, embed
from .similarity import top_vectors

META = ["arxiv_id", "title", "chunk_id", "source_type"]


def build_index(chunks: DataFrame, embedder: Embedder, unit: bool = True) -> DataFrame:
    """vec_id, embedding, arxiv_id, title, chunk_id, source_type of chunk rows; numbered from 0 by paper and chunk.

    Texts are not kept, as they stand in the chunk table.  Null texts count as
    empty, a missing source type is "unknown".  ``unit`` stores vectors of length 1.
    """
    rows = chunks.select(F.coalesce("text", F.lit("")).alias("text"), "arxiv_id", "title", "chunk_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type"))
    # numbered first: the order is found by reading rows twice, and no text should be embedded twice
    return embed(numbered(rows, "vec_id", ["arxiv_id", "chunk_id"]), "text", embedder, unit=unit).select("vec_id", "embedding", *META)


def write_index(index: DataFrame, embedder: Embedder, path: str) -> None:
    """Vectors with their metadata under ``path``/vectors, the embedder's name and width under ``path``/about."""
    index.write.mode("overwrite").parquet(f"{path}/vectors")
    index.sparkSession.createDataFrame([(embedder.name, embedder.width)], "embedder string, width int").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def read_index(spark: SparkSession, path: str, embedder: Embedder) -> DataFrame:
    """The index at ``path``; raises if it is not there or was built with another embedder."""
    about = spark.read.schema("embedder string, width int").json(f"{path}/about").first()
    if about is None or (about["embedder"], about["width"]) != (embedder.name, embedder.width):
        raise ValueError(f"the index holds vectors of {about and about['embedder']}, not of {embedder.name}")
    return spark.read.parquet(f"{path}/vectors")


def search_index(index: DataFrame, queries: DataFrame, embedder: Embedder, k: int = 5) -> DataFrame:
    """(q_doc, q_chunk, doc, chunk, cosine, rank): the ``k`` nearest chunks of every query chunk, best first.

    queries: doc, chunk_id, chunk_text.  Both sides come from one embedder and
    are brought to length 1 in double precision.  Ties go to the smaller vec_id.
    """
    # one key type for both sides: places in the index, and struct-like names of the queries
    asked = embed(queries.select(F.to_json(F.struct("doc", "chunk_id")).alias("key"), "chunk_text"), "chunk_text", embedder).select("key", "embedding")
    rows = index.select(F.format_string("%019d", "vec_id").alias("key"), "embedding")
    found = top_vectors(asked, rows, "key", "embedding", k=k, width=embedder.width)
    kind = queries.schema["doc"].dataType.simpleString()
    back = F.from_json("q", f"doc {kind}, chunk_id int")
    meta = index.select(F.col("vec_id").alias("_v"), F.col("arxiv_id").alias("doc"), F.col("chunk_id").alias("chunk"))
    hits = found.select(back.alias("_q"), F.col("n").cast("long").alias("_v"), "cosine", "rank")
    return hits.join(meta, "_v").select(F.col("_q.doc").alias("q_doc"), F.col("_q.chunk_id").alias("q_chunk"), "doc", "chunk", "cosine", "rank")
