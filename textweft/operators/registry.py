"""Relational operations over users, uploads and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contact import normal_email
from ..session import numbered

USER_VIEW = ["id", "first_name", "last_name", "email", "created_at"]
UPLOAD_VIEW = ["id", "user_id", "filename", "word_count", "status", "uploaded_at", "added_to_corpus"]
REPORT_VIEW = ["id", "document_id", "global_score", "report_data", "created_at", "ai_model_used", "faiss_index_version", "similarity_threshold", "processing_time_seconds"]


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not deleted; an unknown flag counts as deleted."""
    return rows.where(~F.col("is_deleted"))


def lookup(rows: DataFrame, column: str, value, view: list[str], alive: bool) -> DataFrame:
    """At most one row by equality, in its public columns."""
    return (live(rows) if alive else rows).where(F.col(column) == value).limit(1).select(*view)


def uploads_of_users(users: DataFrame, uploads: DataFrame) -> DataFrame:
    """Live uploads with their live users."""
    u = live(users).select(F.col("id").alias("user_id"), "email")
    return live(uploads).select(*UPLOAD_VIEW).join(u, "user_id")


def with_report(uploads: DataFrame, reports: DataFrame) -> DataFrame:
    """Live uploads with their report as a struct, null where there is none."""
    r = reports.select(F.col("document_id").alias("_d"), F.struct(*REPORT_VIEW).alias("report"))
    return live(uploads).select(*UPLOAD_VIEW).join(r, F.col("id") == F.col("_d"), "left").drop("_d")


def acceptable_reports(new: DataFrame, uploads: DataFrame, reports: DataFrame) -> DataFrame:
    """New reports whose upload exists (deleted ones count) and has no report yet; the first of several for one upload."""
    known = new.join(uploads.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    fresh = known.join(reports.select("document_id"), "document_id", "left_anti")
    return fresh.groupBy("document_id").agg(F.min_by(F.struct(*[F.col(c) for c in new.columns if c != "document_id"]), "id").alias("_r")).select("document_id", "_r.*")


def append_with_ids(rows: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows and new rows, these numbered on from the largest key in that order."""
    first = rows.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    fresh = numbered(new.select(*[c for c in rows.columns if c != key]), key, order, first + 1)
    return rows.unionByName(fresh.select(*rows.columns))


def link_accounts(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Match outside profiles (google_id, email, given_name, family_name) to users: user_id, google_id, action.

    By google_id among all users first ("known"), then by address among live
    users ("linked"), else a new user ("created", null user_id).  Several users
    with one address: the smallest id.
    """
    profiles = profiles.groupBy("google_id").agg(F.min_by(F.struct(*[F.col(c) for c in profiles.columns if c != "google_id"]), "email").alias("_r")).select("google_id", "_r.*")
    by_id = users.where("google_id IS NOT NULL").groupBy("google_id").agg(F.min("id").alias("_by_id"))
    by_mail = live(users).where("email IS NOT NULL").groupBy(normal_email(F.col("email")).alias("_mail")).agg(F.min("id").alias("_by_mail"))
    found = profiles.join(by_id, "google_id", "left").withColumn("_mail", normal_email(F.col("email"))).join(by_mail, "_mail", "left")
    action = F.when(F.col("_by_id").isNotNull(), "known").when(F.col("_by_mail").isNotNull(), "linked").otherwise("created")
    return found.select(F.coalesce("_by_id", "_by_mail").alias("user_id"), "google_id", "email", F.col("given_name").alias("first_name"), F.col("family_name").alias("last_name"), action.alias("action"))


def merge_accounts(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """The users after linking: linked users get the google_id, new profiles become users."""
    plan = link_accounts(users, profiles)
    linked = plan.where("action = 'linked'").groupBy("user_id").agg(F.min("google_id").alias("_g"))
    kept = users.join(linked, users["id"] == linked["user_id"], "left").select(*[F.coalesce("_g", "google_id").alias("google_id") if c == "google_id" else users[c] for c in users.columns])
    new = defaults(plan.where("action = 'created'").select("google_id", "email", "first_name", "last_name"), users)
    return append_with_ids(kept, new, "id", ["google_id"])


def defaults(new: DataFrame, table: DataFrame) -> DataFrame:
    """New rows in the columns of ``table``: not deleted, of now, and null where nothing else is said."""
    now = F.current_timestamp()
    fill = {"is_deleted": F.lit(False), "added_to_corpus": F.lit(False), "created_at": now, "uploaded_at": now}
    return new.select(*[(F.col(f.name) if f.name in new.columns else fill.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema.fields])


def insert_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users and the new ones whose address, as it is written, no user has, deleted ones included; the first of several by name.

    new: email and any of the other columns.  Rows without an address are not taken.
    """
    fresh = new.where("email IS NOT NULL").join(users.select("email"), "email", "left_anti")
    names = [F.col(c) for c in fresh.columns if c != "email"]
    once = fresh.groupBy("email").agg(F.min(F.struct(*names)).alias("_r")).select("email", "_r.*") if names else fresh.distinct()
    return append_with_ids(users, defaults(once, users), "id", ["email"])


def insert_uploads(uploads: DataFrame, new: DataFrame, folder: str = "uploads") -> DataFrame:
    """Uploads and one PENDING row for each new (user_id, filename); the path follows from the name, so a later file of that name takes an earlier one's place."""
    rows = new.select("user_id", "filename", F.concat(F.lit(f"{folder}/"), "filename").alias("file_path"), F.lit("PENDING").alias("status"))
    return append_with_ids(uploads, defaults(rows, uploads), "id", ["user_id", "filename"])


def latest_files(drops: DataFrame, order: str) -> DataFrame:
    """Of dropped files (filename, content, ``order``) the last of each name."""
    return drops.groupBy("filename").agg(F.max_by(F.struct(*[F.col(c) for c in drops.columns if c != "filename"]), order).alias("_r")).select("filename", "_r.*")


def insert_reports(reports: DataFrame, new: DataFrame, uploads: DataFrame) -> DataFrame:
    """Reports and the acceptable ones among the new (see :func:`acceptable_reports`), with ids of their own."""
    taken = acceptable_reports(new, uploads, reports).drop("id")
    return append_with_ids(reports, defaults(taken, reports), "id", ["document_id"])
