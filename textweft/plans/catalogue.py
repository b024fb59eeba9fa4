"""The query catalogue: every operator as a query over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import contact
from ..functions import text as tx
from ..functions import vector as vec
from ..operators import chunking, classify, index, labels, phrases, registry, report, similarity
from ..operators.embedding import hashed_terms
from ..session import checkpoint, map_arrow, spread, stored, table, temporary
from ..sources import files, paged
from . import literals, pipelines, sql

THRESHOLD = 0.5
SEED = 42


# -- text ---------------------------------------------------------------
def norm_text(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents").select("doc_id", "text")).select("doc_id", tx.normalise(F.col("text")).alias("norm"))


def norm_latex_literals(spark: SparkSession, root: str) -> DataFrame:
    return literals.frame(spark, literals.LATEX, "k int, raw string").select("k", tx.normalise(F.col("raw")).alias("norm"))


def strip_latex_literals(spark: SparkSession, root: str) -> DataFrame:
    return literals.frame(spark, literals.STRUCTURE, "k int, raw string").select("k", tx.strip_structure(F.col("raw")).alias("stripped"))


def strip_latex_documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", tx.strip_structure(F.col("text")).alias("stripped"))


def pdf_clean_refcut(spark: SparkSession, root: str) -> DataFrame:
    fixed = literals.frame(spark, literals.LAYOUT, "k int, raw string").select(F.col("k").cast("long").alias("k"), "raw")
    rows = fixed.unionByName(table(spark, root, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("raw")))
    return rows.select("k", tx.cut_references(tx.clean_extracted(F.col("raw"))).alias("clean"))


def source_priority_coalesce(spark: SparkSession, root: str) -> DataFrame:
    rows = literals.frame(spark, literals.PRIORITY, "k int, latex string, pdf string, plain string")
    return rows.select("k", tx.first_adequate((F.col("latex"), 4), (F.col("pdf"), 1), (F.col("plain"), 1)).alias("chosen"))


def tokenize(spark: SparkSession, root: str) -> DataFrame:
    words = tx.tokens(tx.collapse(F.col("text")))
    return table(spark, root, "chunked_database").where(F.col("text").isNotNull()).select("row_id", F.size(words).cast("long").alias("n_words"), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("first_word"), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("last_word"))


def last_segment(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "uploads").select("id", tx.last_segment(F.col("file_path")).alias("segment"), F.lower(F.regexp_extract("file_path", r"\.[^./]+$", 0)).alias("suffix"))


def _chunks(spark: SparkSession, root: str, name: str, key: str) -> DataFrame:
    rows = spread(table(spark, root, name).select(F.col(key).alias("doc"), "text")).select("doc", tx.normalise(F.col("text")).alias("norm"))
    return chunking.chunks(rows, "norm")


def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root, "documents", "doc_id").select(F.col("doc").alias("doc_id"), "chunk_id", "chunk_text", "n_words")


def chunk_stats(spark: SparkSession, root: str) -> DataFrame:
    c = _chunks(spark, root, "documents", "doc_id")
    by_doc = c.groupBy("doc").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    kinds = table(spark, root, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("source", F.lit("unknown")).alias("source"))
    return kinds.join(by_doc, "doc").groupBy("source").agg(F.count("*").alias("papers"), F.sum("n").cast("long").alias("chunks"), F.sum("w").cast("long").alias("words"))


def extraction_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunked_database").select("arxiv_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type"))
    return rows.groupBy("source_type").agg(F.count("*").alias("chunks"), F.countDistinct("arxiv_id").alias("papers"))


# -- similarity ----------------------------------------------------------
def knn_embeddings_topk(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return similarity.top_vectors(e, e, "vec_id", "embedding").select(F.col("q").alias("vec_id"), F.col("n").alias("neighbour"), F.round("cosine", 4).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def knn_index_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "faiss_metadata")
    found = similarity.top_vectors(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding")
    meta = rows.select(F.col("vec_id").alias("n"), "arxiv_id", "chunk_id")
    return found.join(meta, "n").select(F.col("q").alias("vec_id"), F.col("n").alias("neighbour"), F.round(vec.clamp(F.col("cosine")), 4).alias("cosine"), F.col("rank").cast("long").alias("rank"), "arxiv_id", "chunk_id")


def knn_threshold(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    found = similarity.top_vectors(e, e, "vec_id", "embedding", least=0.4)
    return found.groupBy("q").agg(F.count("*").alias("near"), F.round(F.max("cosine"), 4).alias("best")).withColumnRenamed("q", "vec_id")


def l2_normalize(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "faiss_metadata").where(F.size("embedding") > 0)
    clean = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    unit = vec.l2_normalise(F.col("embedding"))
    return clean.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(vec.norm(F.col("embedding")), 4).alias("norm"), F.round(F.element_at(unit, 1), 4).alias("first"))


def _matches(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # read several times below, so computed once
    q, c = stored(_chunks(spark, root, "eval_items", "item_id")), stored(_chunks(spark, root, "documents", "doc_id"))
    found = similarity.top_texts(q, c, k=5, least=THRESHOLD)
    return checkpoint(report.scored(found, THRESHOLD)), q, c


def sparse_cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    m, _, _ = _matches(spark, root)
    return m.select(F.col("q_doc").alias("item_id"), "q_chunk", F.col("doc").alias("doc_id"), "chunk", "score", "match_percentage", F.col("rank").cast("long").alias("rank"))


def near_duplicates_self(spark: SparkSession, root: str) -> DataFrame:
    c = stored(_chunks(spark, root, "documents", "doc_id"))
    found = similarity.top_texts(c.where("doc % 50 = 0"), c, k=5, least=0.8)
    return found.select(F.col("q_doc").alias("doc_id"), "q_chunk", F.col("doc").alias("other_doc"), "chunk", F.round("cosine", 4).alias("score"))


def near_duplicates_all(spark: SparkSession, root: str) -> DataFrame:
    c = stored(_chunks(spark, root, "documents", "doc_id"))
    found = similarity.near_texts(c.where("doc % 50 = 0"), c, least=0.8)
    return found.select(F.col("q_doc").alias("doc_id"), "q_chunk", F.col("doc").alias("other_doc"), "chunk", F.round("cosine", 4).alias("score"))


def flagged_chunks(spark: SparkSession, root: str) -> DataFrame:
    m, _, _ = _matches(spark, root)
    return report.flagged_chunks(m).select(F.col("q_doc").alias("item_id"), "q_chunk", F.round("best", 4).alias("best"))


def global_score(spark: SparkSession, root: str) -> DataFrame:
    m, q, _ = _matches(spark, root)
    return report.global_scores(m, q).withColumnRenamed("q_doc", "item_id")


def _with_texts(m: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    a = q.select(F.col("doc").alias("q_doc"), F.col("chunk_id").alias("q_chunk"), F.col("chunk_text").alias("query_text"))
    b = c.select("doc", F.col("chunk_id").alias("chunk"), F.col("chunk_text").alias("db_text"))
    return m.join(a, ["q_doc", "q_chunk"]).join(b, ["doc", "chunk"])


def shared_word_6grams(spark: SparkSession, root: str) -> DataFrame:
    m, q, c = _matches(spark, root)
    pairs = _with_texts(m, q, c)
    both = F.size(F.array_intersect(phrases.word_grams(F.col("query_text"), 6), phrases.word_grams(F.col("db_text"), 6)))
    return pairs.select(F.col("q_doc").alias("item_id"), "q_chunk", F.col("doc").alias("doc_id"), "chunk", both.cast("long").alias("shared"))


def rank_sources(spark: SparkSession, root: str) -> DataFrame:
    m, q, c = _matches(spark, root)
    top = _with_texts(report.top_matches(m), q, c).withColumn("exact", phrases.shares_grams(F.col("query_text"), F.col("db_text"), 6))
    ranked = report.rank_sources(top, report.first_seen(m), "exact")
    return ranked.select(F.col("q_doc").alias("item_id"), F.col("doc").alias("doc_id"), F.col("match_count").cast("long").alias("match_count"), "average_similarity", "has_exact", F.col("position").cast("long").alias("position"))


def exact_phrases(spark: SparkSession, root: str) -> DataFrame:
    m, q, c = _matches(spark, root)
    found = phrases.exact_phrases(_with_texts(report.top_matches(m), q, c), "query_text", "db_text")
    return found.select(F.col("q_doc").alias("item_id"), "q_chunk", F.col("doc").alias("doc_id"), "chunk", F.explode("phrases").alias("phrase"))


def _analysis(spark: SparkSession, root: str) -> DataFrame:
    m, q, c = _matches(spark, root)
    top = phrases.exact_phrases(_with_texts(report.top_matches(m), q, c), "query_text", "db_text").withColumn("exact", F.size("phrases") > 0)
    top = checkpoint(top.drop("db_text"))
    ranked = report.rank_sources(top, report.first_seen(m), "exact")
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("collection", F.lit("N/A")).alias("title"), F.coalesce("source", F.lit("unknown")).alias("source_type"))
    texts = c.join(docs.select("doc", "source_type"), "doc")
    names = table(spark, root, "eval_items").select(F.col("item_id").alias("q_doc"), F.concat(F.lit("item-"), F.col("item_id"), F.lit(".txt")).alias("file_name"))
    return report.report_documents(names, report.global_scores(m, q), ranked, top, texts, docs.select("doc", "title"), THRESHOLD, "term-frequency")


def report_json(spark: SparkSession, root: str) -> DataFrame:
    return _analysis(spark, root).withColumnRenamed("q_doc", "item_id")


def analyze_report(spark: SparkSession, root: str) -> DataFrame:
    m, q, c = _matches(spark, root)
    top = _with_texts(report.top_matches(m), q, c).withColumn("exact", phrases.shares_grams(F.col("query_text"), F.col("db_text"), 6))
    ranked = report.rank_sources(top, report.first_seen(m), "exact").groupBy("q_doc").agg(F.count("*").alias("reported"))
    head = report.global_scores(m, q).join(ranked, "q_doc", "left")
    return head.select(F.col("q_doc").alias("item_id"), "total_words", "total_chunks", "global_score", "total_suspicious_sources", F.coalesce("reported", F.lit(0)).alias("total_reported_sources"), "total_flagged_chunks")


# -- dataset -------------------------------------------------------------
def hierarchy_flatten(spark: SparkSession, root: str) -> DataFrame:
    path = temporary(spark, "hierarchy")
    literals.frame(spark, [(literals.HIERARCHY,)], "value string").coalesce(1).write.text(path)
    return labels.flatten_hierarchy(files.hierarchy(spark, path)).unionByName(labels.flatten_hierarchy(_dim_tree(spark, root)))


def _dim_tree(spark: SparkSession, root: str) -> DataFrame:
    dim = table(spark, root, "category_dim").where("sub_code <> top_code")
    return dim.groupBy("top_code", "top_name").agg(F.map_from_entries(F.collect_list(F.struct("sub_code", "sub_name"))).alias("subs")).withColumn("ord", F.xxhash64("top_code"))


def label_map_fallback(spark: SparkSession, root: str) -> DataFrame:
    taxonomy = table(spark, root, "category_dim").select("sub_code", "top_code", "top_name", "sub_name")
    rows = table(spark, root, "papers").select("record_id", "primary_category", "all_categories")
    return labels.map_labels(rows, taxonomy, "record_id", "primary_category", "all_categories").select("record_id", "top_code", F.col("top_name"), F.col("sub_name"))


def source_predicate(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "papers").where(F.array_contains("all_categories", "cmp.DB")).select("record_id", "arxiv_id")


def dedupe_first_wins(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "papers").select("record_id", F.trim("arxiv_id").alias("arxiv_id"), "feed", "ingested_at").where(F.trim("arxiv_id") != "")
    return labels.first_wins(rows, ["arxiv_id"], [F.col("feed"), F.col("ingested_at"), F.col("record_id")]).select("arxiv_id", "record_id", "feed")


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "papers").select("record_id", F.trim("top_category_name").alias("label")).where("label <> ''")


def balance_classes(spark: SparkSession, root: str) -> DataFrame:
    return labels.balance(_labelled(spark, root), "label", "record_id", most=100, least=30, seed=SEED)


def stratified_split(spark: SparkSession, root: str) -> DataFrame:
    return labels.stratified_split(_labelled(spark, root), "label", "record_id", seed=SEED)


def split_sizes(spark: SparkSession, root: str) -> DataFrame:
    return stratified_split(spark, root).groupBy("label", "split").agg(F.count("*").alias("n"))


def per_category_quota(spark: SparkSession, root: str) -> DataFrame:
    return labels.quota(table(spark, root, "events").select("event_type", "event_id", "ts"), "event_type", [F.desc("ts"), F.col("event_id")], 50).select("event_type", "event_id")


def newest_papers_by_category(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "papers").select("record_id", F.explode_outer(F.array_distinct("all_categories")).alias("category"), "published").where("category IS NOT NULL")
    return labels.quota(rows, "category", [F.desc_nulls_last("published"), F.col("record_id")], 20).select("category", "record_id")


def jsonl_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "text", "lang", "source")
    path = temporary(spark, "lines")
    files.write_json_lines(rows, path)
    return files.json_lines(spark, path, "doc_id bigint, text string, lang string, source string").select("doc_id", F.md5(F.coalesce("text", F.lit("<null>"))).alias("digest"), "lang", "source")


def json_fields(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def atom_parse(spark: SparkSession, root: str) -> DataFrame:
    found = files.atom_entries(literals.frame(spark, literals.ENTRIES, "k int, xml string"), "xml")
    return found.select("arxiv_id", "title", "abstract", "primary_category", F.array_join("all_categories", ",").alias("categories"))


def largest_member(spark: SparkSession, root: str) -> DataFrame:
    rows = literals.frame(spark, literals.archives(), "path string, content binary")
    return files.archive_sources(rows).where("latex IS NOT NULL").select(F.col("path").alias("archive"), F.regexp_extract("latex", "^[^~]*", 0).alias("member"))


def chunk_lines(spark: SparkSession, root: str) -> DataFrame:
    """Chunk rows through a file with mandatory columns."""
    path = temporary(spark, "chunks")
    rows = table(spark, root, "chunked_database").where("text IS NOT NULL AND arxiv_id IS NOT NULL AND title IS NOT NULL AND chunk_id IS NOT NULL")
    files.write_json_lines(rows.select("arxiv_id", "title", "chunk_id", "text", "source_type"), path)
    return files.chunk_lines(spark, path).groupBy("source_type").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars"))


def chunk_texts(spark: SparkSession, root: str) -> DataFrame:
    """Texts of a chunk file and of one that is not there."""
    path = temporary(spark, "chunks")
    files.write_json_lines(table(spark, root, "chunked_database").where("text IS NOT NULL").select("arxiv_id", "chunk_id", "text"), path)
    both = files.chunk_texts(spark, path).unionByName(files.chunk_texts(spark, path + "-absent"))
    return both.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


def paged_scan(spark: SparkSession, root: str) -> DataFrame:
    """Pages of an API, at most ten records a category; categories that are not wanted are not asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.paged_source("textweft_paged", "category string, i int", literals.page))
    rows = spark.read.format("textweft_paged").options(categories="d, b, c, a", per_category=10, batch_size=3).load()
    return rows.where("category IN ('a', 'c', 'd')")


def source_urls(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "papers").select("record_id", contact.link("https://papers.example/source/%s", F.trim("arxiv_id")).alias("url"), contact.quoted(F.col("title")).alias("quoted"))


def chunk_vectors(spark: SparkSession, root: str) -> DataFrame:
    meta = table(spark, root, "faiss_metadata").select("vec_id", "arxiv_id", "chunk_id")
    texts = table(spark, root, "chunked_database").where("arxiv_id IS NOT NULL").groupBy("arxiv_id", "chunk_id").agg(F.min_by("text", "row_id").alias("text"))
    return meta.join(texts, ["arxiv_id", "chunk_id"], "left").select("vec_id", "arxiv_id", "chunk_id", F.length(F.coalesce("text", F.lit("Text not available."))).cast("long").alias("n_chars"))


# -- registry ------------------------------------------------------------
def user_lookup(spark: SparkSession, root: str) -> DataFrame:
    return registry.lookup(table(spark, root, "users"), "id", 7, registry.USER_VIEW, alive=True)


def user_by_email(spark: SparkSession, root: str) -> DataFrame:
    users = table(spark, root, "users")
    live = registry.live(users).withColumn("mail", contact.normal_email(F.col("email")))
    return live.groupBy("mail").agg(F.min("id").alias("user_id"), F.count("*").alias("accounts"))


def doc_with_report(spark: SparkSession, root: str) -> DataFrame:
    both = registry.with_report(table(spark, root, "uploads"), table(spark, root, "plagiarism_reports"))
    return both.select("id", "user_id", "filename", "status", F.col("report.id").alias("report_id"), F.col("report.global_score").alias("global_score"))


def user_documents(spark: SparkSession, root: str) -> DataFrame:
    return registry.uploads_of_users(table(spark, root, "users"), table(spark, root, "uploads")).groupBy("user_id").agg(F.count("*").alias("uploads"), F.sum("word_count").cast("long").alias("words"), F.max("uploaded_at").alias("last_upload"))


def report_of_document(spark: SparkSession, root: str) -> DataFrame:
    return registry.lookup(table(spark, root, "plagiarism_reports"), "document_id", 2, ["id", "document_id", "global_score", "ai_model_used"], alive=False)


def report_insert_valid(spark: SparkSession, root: str) -> DataFrame:
    uploads, reports = table(spark, root, "uploads"), table(spark, root, "plagiarism_reports")
    new = uploads.select((F.col("id") + 5).alias("document_id"), F.col("id").alias("id"), F.lit(0.0).alias("global_score"))
    return registry.acceptable_reports(new, uploads, reports).select("document_id", "id", "global_score")


def report_fields(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "plagiarism_reports").withColumn("d", F.from_json("report_data", schemas.REPORT_DATA))
    return r.select("id", F.col("d.document_stats.total_words").alias("total_words"), F.col("d.total_flagged_chunks").alias("flagged"), F.coalesce(F.size("d.sources"), F.lit(0)).cast("long").alias("sources"), F.col("d.error").alias("error"))


def account_merge(spark: SparkSession, root: str) -> DataFrame:
    return registry.link_accounts(table(spark, root, "users"), _profiles(spark, root)).select("google_id", "user_id", "action")


def _profiles(spark: SparkSession, root: str) -> DataFrame:
    """Outside profiles of all users: a third by their google_id, a third by their address, a third new ones."""
    users = table(spark, root, "users")
    known = users.where("id % 3 = 1 AND google_id IS NOT NULL").select("google_id", "email", "first_name", "last_name")
    by_mail = users.where("id % 3 = 2").select(F.concat(F.lit("n-"), F.col("id")).alias("google_id"), F.upper("email").alias("email"), "first_name", "last_name")
    new = users.where("id % 3 = 0").select(F.concat(F.lit("m-"), F.col("id")).alias("google_id"), F.concat(F.lit("new."), F.trim("email")).alias("email"), "first_name", "last_name")
    return known.unionByName(by_mail).unionByName(new).withColumnsRenamed({"first_name": "given_name", "last_name": "family_name"})


def accounts_after_merge(spark: SparkSession, root: str) -> DataFrame:
    return registry.merge_accounts(table(spark, root, "users"), _profiles(spark, root)).select("id", "email", "google_id", "is_deleted")


def schema_upgrade(spark: SparkSession, root: str) -> DataFrame:
    """Users of the first schema, without outside accounts and with an integer id, in the present one."""
    first = table(spark, root, "users").select(F.col("id").cast("int").alias("id"), "first_name", "last_name", "email", "hashed_password", "created_at", "is_deleted", "deleted_at", F.lit(1).alias("legacy"))
    return schemas.upgrade(first, schemas.USERS)


def user_insert(spark: SparkSession, root: str) -> DataFrame:
    """All users sign up again, every other one with a new address."""
    users = table(spark, root, "users")
    new = users.select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("reg."), F.trim("email"))).otherwise(F.col("email")).alias("email"), "first_name", "last_name")
    return registry.insert_users(users, new).select("id", "email", "is_deleted")


def upload_insert(spark: SparkSession, root: str) -> DataFrame:
    uploads = table(spark, root, "uploads")
    new = uploads.select("user_id", F.concat(F.lit("again-"), F.col("filename")).alias("filename"))
    return registry.insert_uploads(uploads, new).select("id", "user_id", "filename", "file_path", "status", "added_to_corpus")


def upload_files(spark: SparkSession, root: str) -> DataFrame:
    """What stands in the upload folder: the last file of each name."""
    drops = table(spark, root, "uploads").where("filename IS NOT NULL").select("filename", "id", F.md5(F.concat_ws("|", "id", "file_path")).alias("content"))
    return registry.latest_files(drops, "id").select("filename", F.col("id").alias("upload_id"), "content")


def report_insert(spark: SparkSession, root: str) -> DataFrame:
    uploads, reports = table(spark, root, "uploads"), table(spark, root, "plagiarism_reports")
    new = uploads.select((F.col("id") + 5).alias("document_id"), F.col("id").alias("id"), F.lit(0.5).alias("global_score"), F.lit("{}").alias("report_data"))
    return registry.insert_reports(reports, new, uploads).select("id", "document_id", "global_score")


def report_expiry(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "plagiarism_reports").select("id", contact.expiry(F.col("created_at"), 30).alias("expires_at"))


def input_valid(spark: SparkSession, root: str) -> DataFrame:
    u = table(spark, root, "users")
    return u.select("id", (contact.first_given(F.trim("first_name")) != "").alias("named"), contact.long_enough(F.col("hashed_password")).alias("password"), contact.first_given(F.col("first_name"), F.col("last_name")).alias("shown"))


def initials(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "users").select("id", contact.initials(F.col("first_name"), F.col("last_name"), F.col("email")).alias("initials"))


def email_valid(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "users").select("id", contact.valid_email(F.col("email")).alias("valid"))


def email_norm(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "users").select("id", contact.normal_email(F.col("email")).alias("email"))


def status_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "uploads").groupBy("status", "is_deleted").agg(F.count("*").alias("n"))


# -- classifier ----------------------------------------------------------
def classification_report(spark: SparkSession, root: str) -> DataFrame:
    top = F.initcap(tx.collapse(F.col("top_category_name")))
    dim = table(spark, root, "category_dim").where("sub_code = top_code").select(F.col("top_code").alias("c"), F.col("top_name").alias("prediction"))
    rows = table(spark, root, "papers").select(top.alias("label"), F.substring_index(F.trim("primary_category"), ".", 1).alias("c"))
    return classify.evaluation(rows.where("label <> ''").join(dim, "c"))


def label_list(spark: SparkSession, root: str) -> DataFrame:
    return classify.label_list(table(spark, root, "papers"), "top_category_name").select(F.col("position").cast("long").alias("position"), "label")


def train_text(spark: SparkSession, root: str) -> DataFrame:
    return classify.training_text(table(spark, root, "papers"))


def mlp_predict(spark: SparkSession, root: str) -> DataFrame:
    """Labels of held-out vectors, by a model trained on the others, saved and loaded again."""
    rows = labels.stratified_split(table(spark, root, "embeddings").withColumn("label", F.col("label").cast("string")), "label", "vec_id", seed=SEED)
    path = temporary(spark, "model")
    classify.save(classify.fit_classifier(rows.where("split = 'train'"), "embedding", "label"), path, embedder="stored vectors", seed=SEED)
    return classify.predict(classify.load(path), rows.where("split <> 'train'"), "embedding").select("vec_id", "label", "prediction")


# -- pipelines -----------------------------------------------------------
def corpus_build(spark: SparkSession, root: str) -> DataFrame:
    taxonomy = table(spark, root, "category_dim").select("sub_code", "top_code", "top_name", "sub_name")
    rows = table(spark, root, "papers").select("record_id", "arxiv_id", "primary_category", "all_categories", "feed")
    built = pipelines.corpus(rows, taxonomy, [F.col("primary_category"), F.col("record_id")], most=100, least=30, seed=SEED)
    path = temporary(spark, "corpus")
    pipelines.write_corpus(built, path)
    whole = None
    for name in ("train", "val", "test"):
        part = files.json_lines(spark, f"{path}/{name}", "arxiv_id string, record_id bigint, top_name string, sub_name string").withColumn("split", F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _papers_with_sources(spark: SparkSession, root: str) -> DataFrame:
    """Documents as papers: a third with a tar archive, a third with a gzipped source, a third with a PDF only."""

    def pack(batches):
        import gzip
        import io
        import tarfile

        import pyarrow as pa

        for batch in batches:
            archives, pdfs = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = None if text is None else text.encode()
                if body is not None and key % 3 == 0:
                    buffer = io.BytesIO()
                    with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as tar:
                        for name, part in (("part.tex", body[: len(body) // 3]), ("main.tex", body), ("plot.eps", body * 2)):
                            info = tarfile.TarInfo(name)
                            info.size = len(part)
                            tar.addfile(info, io.BytesIO(part))
                    archives.append(buffer.getvalue())
                else:
                    archives.append(gzip.compress(body, 1) if body is not None and key % 3 == 1 else None)
                pdfs.append(body if key % 3 == 2 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(archives, pa.binary()), pa.array(pdfs, pa.binary())], names=["doc_id", "archive", "pdf"])

    packed = map_arrow(spread(table(spark, root, "documents").select("doc_id", "text")), pack, "doc_id bigint, archive binary, pdf binary")
    return packed.select(F.col("doc_id").cast("string").alias("arxiv_id"), F.lit("title").alias("title"), "archive", "pdf")


def paper_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Source archives and PDFs to chunk rows, written and read again."""
    path = temporary(spark, "chunks")
    pipelines.write_chunks(pipelines.paper_chunks(_papers_with_sources(spark, root), lambda b: b.decode("utf-8", "replace")), path)
    return spark.read.parquet(path).select("arxiv_id", "chunk_id", "text", "source_type")


def paper_chunk_counts(spark: SparkSession, root: str) -> DataFrame:
    return pipelines.chunk_counts(paper_chunks(spark, root))


def _corpus_chunks(spark: SparkSession, root: str) -> DataFrame:
    about = table(spark, root, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("collection", F.lit("N/A")).alias("title"), F.coalesce("source", F.lit("unknown")).alias("source_type"))
    c = _chunks(spark, root, "documents", "doc_id").join(about, "doc")
    return stored(c.select(F.col("doc").cast("string").alias("arxiv_id"), "title", "chunk_id", F.col("chunk_text").alias("text"), "source_type"))


def _index(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    embedder, path = hashed_terms(), temporary(spark, "index")
    index.write_index(index.build_index(chunks, embedder, unit=False), embedder, path)
    return index.read_index(spark, path, embedder)


def index_build(spark: SparkSession, root: str) -> DataFrame:
    """Chunk rows to an index, written and read again."""
    v = _index(spark, _corpus_chunks(spark, root))
    total = lambda f: F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda a, x: a + x).cast("long")
    return v.select("vec_id", "arxiv_id", "chunk_id", "source_type", total(lambda x: x).alias("terms"), total(lambda x: x * x).alias("squares"), F.size("embedding").cast("long").alias("width"))


def _file_reports(spark: SparkSession, root: str) -> DataFrame:
    """Every held-out item as a file, a third of them LaTeX, against the index of all documents."""
    suffix = F.when(F.col("item_id") % 3 == 0, ".tex").otherwise(".txt")
    asked = table(spark, root, "eval_items").select(F.concat(F.lit("/in/item-"), F.col("item_id"), suffix).alias("path"), F.encode("text", "UTF-8").alias("content"))
    chunks = _corpus_chunks(spark, root)
    return pipelines.analyze(asked, _index(spark, chunks), chunks, hashed_terms())


def analyze_file(spark: SparkSession, root: str) -> DataFrame:
    """Heads of the whole reports on files."""
    head = "file_name string, error string, document_stats struct<total_words: bigint, total_chunks_analyzed: bigint>, global_plagiarism_score_percent double, total_suspicious_sources bigint, total_flagged_chunks bigint"
    r = _file_reports(spark, root).select("path", F.from_json("report", head).alias("r"))
    return r.select("path", "r.file_name", F.col("r.error").isNotNull().alias("failed"), F.col("r.document_stats.total_words").alias("total_words"), F.col("r.document_stats.total_chunks_analyzed").alias("total_chunks"), F.col("r.global_plagiarism_score_percent").alias("global_score"), "r.total_suspicious_sources", "r.total_flagged_chunks")


def analyze_file_report(spark: SparkSession, root: str) -> DataFrame:
    """The whole reports, written and read again."""
    path = temporary(spark, "reports")
    files.write_reports(_file_reports(spark, root), path)
    return spark.read.text(path).withColumnRenamed("value", "report")


def stream_filedrop(spark: SparkSession, root: str) -> DataFrame:
    from ..streaming import filedrop

    source = table(spark, root, "documents").select("doc_id", "text")
    home = temporary(spark, "filedrop")
    drop, target = f"{home}/in", f"{home}/out"
    source.write.mode("overwrite").parquet(drop)
    filedrop.write_once(filedrop.watch(spark, drop, source.schema), "doc_id", target, f"{home}/state", lambda d: d.select("doc_id", F.size(tx.tokens(tx.normalise(F.col("text")))).alias("n_words")))
    return spark.read.parquet(target).drop("batch")


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Heads of the whole reports on every held-out item, with sources preferred by phrases found character by character.

    ``analyze_report`` is the same but for that: it takes six words in a row for a phrase.
    """
    head = "error string, document_stats struct<total_words: bigint, total_chunks_analyzed: bigint>, global_plagiarism_score_percent double, total_suspicious_sources bigint, total_reported_sources bigint, total_flagged_chunks bigint"
    r = _analysis(spark, root).select(F.col("q_doc").alias("item_id"), F.from_json("report", head).alias("r"))
    return r.select("item_id", "r.error", F.col("r.document_stats.total_words").alias("total_words"), F.col("r.document_stats.total_chunks_analyzed").alias("total_chunks"), F.col("r.global_plagiarism_score_percent").alias("global_score"), "r.total_suspicious_sources", "r.total_reported_sources", "r.total_flagged_chunks")


HELPERS = {"queries", "oracle_sql"}


def queries() -> dict:
    here = globals()
    return {n: f for n, f in sorted(here.items()) if callable(f) and n[0] != "_" and n not in HELPERS and getattr(f, "__module__", "") == __name__ and isinstance(f, type(queries))}


def oracle_sql() -> dict[str, str]:
    return sql.statements()


__all__ = ["flagship", "oracle_sql", "queries"]
