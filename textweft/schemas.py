"""Schemas of the tables and files of the pipeline, as DDL."""

from __future__ import annotations



PAPER = "arxiv_id string, title string, abstract string, published string, updated string, primary_category string, all_categories array<string>, top_category string, top_category_name string, subcategory_name string"
CHUNK = "arxiv_id string, title string, chunk_id int, text string, source_type string"
VECTOR = "vec_id bigint, embedding array<float>, arxiv_id string, title string, chunk_id int, source_type string"
HIERARCHY = "map<string, struct<name: string, subcategories: map<string, string>>>"
USERS = "id bigint, first_name string, last_name string, email string, hashed_password string, google_id string, created_at timestamp_ntz, is_deleted boolean, deleted_at timestamp_ntz"
UPLOADS = "id bigint, user_id bigint, filename string, file_path string, word_count int, status string, uploaded_at timestamp_ntz, added_to_corpus boolean, is_deleted boolean, deleted_at timestamp_ntz"
REPORTS = "id bigint, document_id bigint, global_score double, report_data string, created_at timestamp_ntz, ai_model_used string, faiss_index_version string, similarity_threshold double, processing_time_seconds double"
REPORT_DATA = "error string, document_stats struct<total_words: bigint, total_chunks_analyzed: bigint>, total_flagged_chunks bigint, sources array<struct<arxiv_id: string, match_count: int, average_similarity_percent: double, has_exact_copies: boolean>>"
STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")


def upgrade(rows, schema: str):
    """Bring a table to a later schema (DDL): missing columns come as nulls, others are cast; extra ones are dropped."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])
