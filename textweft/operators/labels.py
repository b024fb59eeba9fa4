"""Taxonomy lookups and building a labelled, balanced, split dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten_hierarchy(tree: DataFrame) -> DataFrame:
    """sub_code, top_code, top_name, sub_name from rows (ord, top_code, top_name, subs map<code, name>).

    Every top code is its own subcategory unless listed; a code under several
    tops belongs to the last; missing names fall back to the code above.
    """
    listed = tree.select("ord", "top_code", F.coalesce("top_name", "top_code").alias("top_name"), F.explode("subs").alias("sub_code", "sub_name"))
    own = tree.select(F.lit(-1).cast("long").alias("ord"), "top_code", F.coalesce("top_name", "top_code").alias("top_name"), F.col("top_code").alias("sub_code"), F.coalesce("top_name", "top_code").alias("sub_name"))
    last = listed.select(F.col("ord").cast("long"), "top_code", "top_name", "sub_code", "sub_name").unionByName(own)
    return last.groupBy("sub_code").agg(F.max_by(F.struct("top_code", "top_name", "sub_name"), "ord").alias("_r")).select("sub_code", "_r.top_code", "_r.top_name", "_r.sub_name")


def map_labels(rows: DataFrame, taxonomy: DataFrame, key: str, primary: str, others: str) -> DataFrame:
    """Add top_code, top_name, sub_name: of ``primary`` if it maps, else of the first of ``others`` that does; rows without any are dropped.

    taxonomy: sub_code, top_code, top_name, sub_name, one row a code.  Keys must be unique.
    """
    tried = rows.select(key, F.posexplode(F.concat(F.array(primary), F.coalesce(others, F.array().cast("array<string>")))).alias("_pos", "sub_code"))
    hit = tried.join(taxonomy, "sub_code").groupBy(key).agg(F.min_by(F.struct("top_code", "top_name", "sub_name"), "_pos").alias("_l"))
    return rows.join(hit, key).select(rows["*"], "_l.top_code", "_l.top_name", "_l.sub_name")


def first_wins(rows: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """The first row of every identity in that order; null identities are dropped.

    Aggregates ``min_by`` before the shuffle, so a hot identity is never ordered in one task.
    """
    present = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in identity))
    best = present.groupBy(*identity).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def seeded(seed: int, *keys: str) -> Column:
    """A reproducible order that does not follow the keys: the md5 of key and seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def balance(rows: DataFrame, label: str, key: str, most: int, least: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each label, in seeded order; labels with fewer than ``least`` are dropped.

    The count is a separate small aggregate, so the window keeps its limit and
    each task passes on at most ``most`` rows a label.
    """
    big = rows.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    w = Window.partitionBy(label).orderBy(seeded(seed, key), key)
    return rows.join(big, label, "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def stratified_split(rows: DataFrame, label: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Add split: of each label floor(n * train) rows train, floor(n * val) val, the rest test.

    The position in the seeded order comes from counts by 65,536 hash ranges plus
    the position inside one range, so no label is ordered in one task.
    """
    marked = rows.withColumn("_h", seeded(seed, key)).withColumn("_bin", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    sums = marked.groupBy(label, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(label)))
    inside = Window.partitionBy(label, "_bin").orderBy("_h", key)
    same = F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bin") == F.col("_b"))
    placed = marked.withColumn("_i", F.row_number().over(inside)).join(offsets.select(F.col(label).alias("_label"), F.col("_bin").alias("_b"), "_before", "_all"), same)
    at, n_train, n_val = F.col("_before") + F.col("_i"), F.floor(F.col("_all") * F.lit(float(train))), F.floor(F.col("_all") * F.lit(float(val)))
    return placed.withColumn("split", F.when(at <= n_train, "train").when(at <= n_train + n_val, "val").otherwise("test")).select(*rows.columns, "split")


def quota(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of every group; the limit is applied before the shuffle too."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
