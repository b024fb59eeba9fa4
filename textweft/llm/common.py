"""Pieces shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"(?U)[\s\x1c-\x1f]+"


def squeeze(col: Column) -> Column:
    """Lower case, outer blanks off, inner runs of blanks made one space."""
    return F.lower(F.trim(F.regexp_replace(col, BLANK, " ")))


def unit_interval(*cols: Column) -> Column:
    """A reproducible uniform number in (0, 1) from the hash of ``cols``."""
    low = F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))
    return (low.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def require(df: DataFrame, *names: str) -> None:
    """Raise early when a column an operator needs is not there."""
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"missing columns {gone}; the table has {df.columns}")


def bounded_collect(df: DataFrame, most: int, what: str) -> list:
    """Collect a result that must be small by its nature; refuse if it is not.

    Raises rather than cutting the result, so nothing is lost silently.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; raise the bound or use fewer margins")
    return rows


def take_by_threshold(df: DataFrame, group: list[str], rank: str, tie: str, amount: str, quotas: DataFrame, whole: str, bins: int = 4096, scale_free: bool = False) -> DataFrame:
    """Rows of each group with the smallest ``rank`` until ``amount`` sums to the quota.

    Works without ordering a whole group in one task: amounts are summed by
    ``bins`` equal ranges of ``rank`` (a number in [0, 1)), or, with
    ``scale_free``, by ranges of one 64th of a doubling of a positive ``rank``
    of any size; the range in which the quota falls is found from those sums,
    and only the rows inside that one range are ordered.  A row is taken if the
    running sum up to and including it stays within the quota.

    quotas: ``group`` columns and ``whole``, the quota.  Groups without a quota
    give no row.
    """
    place = F.floor(F.log2(F.col(rank)) * 64) if scale_free else F.least(F.lit(bins - 1), F.floor(F.col(rank) * bins))
    binned = df.withColumn("_bin", place.cast("int"))
    sums = binned.groupBy(*group, "_bin").agg(F.sum(amount).alias("_sum"))
    from pyspark.sql import Window as W

    before = W.partitionBy(*group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    edges = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(quotas.select(*group, whole), group)
        .withColumn("_rest", F.col(whole) - F.col("_before"))
        .where(F.col("_rest") > 0)
        .select(*group, "_bin", "_rest", (F.col("_sum") <= F.col("_rest")).alias("_all"))
    )
    joined = binned.join(edges, [*group, "_bin"])
    inside = W.partitionBy(*group, "_bin").orderBy(rank, tie).rowsBetween(W.unboundedPreceding, 0)
    sure = joined.where("_all")
    edge = joined.where("NOT _all").withColumn("_run", F.sum(amount).over(inside)).where("_run <= _rest").drop("_run")
    return sure.unionByName(edge).drop("_bin", "_rest", "_all")
