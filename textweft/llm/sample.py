"""Problem 1: a sample whose category shares follow given targets.

Weights are raked by iterative proportional fitting over several margins,
rows are drawn by weighted exponential keys, minimums the draw has missed are
repaired, and what is still missing is reported for every margin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_collect, require, squeeze, take_by_threshold, unit_interval

#: Cells of the contingency table (categories x other margins).  Margins are
#: label-like columns; a table beyond this is refused, never cut.
MAX_CELLS = 1_000_000


@dataclass
class Sampled:
    rows: DataFrame
    report: DataFrame
    margins: DataFrame
    size: int
    pool: int


def with_category(papers: DataFrame, dim: DataFrame, name: str = "top_category_name", code: str = "primary_category", out: str = "category") -> DataFrame:
    """Add the category a row belongs to, or null.

    The category is the ``top_name`` equal to ``name`` (case, outer and
    repeated blanks ignored); failing that the ``top_name`` behind the
    ``sub_code`` equal to ``code``; failing that null.  Nulls and blanks match
    nothing.  Codes or names listed twice resolve to the smallest top_name.
    """
    require(papers, name, code)
    names = dim.where(F.col("top_name").isNotNull()).groupBy(squeeze(F.col("top_name")).alias("_nk")).agg(F.min("top_name").alias("_by_name"))
    codes = dim.where(F.col("sub_code").isNotNull()).groupBy(squeeze(F.col("sub_code")).alias("_ck")).agg(F.min("top_name").alias("_by_code"))
    # the row travels as one column, so its own column names cannot clash
    packed = papers.select(F.struct(*[F.col(c) for c in papers.columns if c != out]).alias("_row"), squeeze(F.col(name)).alias("_nk"), squeeze(F.col(code)).alias("_ck"))
    return packed.join(names, "_nk", "left").join(codes, "_ck", "left").select("_row.*", F.coalesce("_by_name", "_by_code").alias(out))


def fill_to(wanted: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """Scale ``wanted`` to ``total`` without passing ``most``; what is cut off goes to the others in proportion."""
    got = np.minimum(wanted, most)
    for _ in range(len(got) + 1):
        free = (got < most) & (wanted > 0)
        rest = total - got.sum()
        if rest <= 1e-9 or not free.any():
            break
        got = np.where(free, np.minimum(most, got + rest * wanted / wanted[free].sum()), got)
    return got


def whole_numbers(x: np.ndarray, most: np.ndarray, total: int) -> np.ndarray:
    """Largest-remainder rounding of ``x`` to integers that sum to ``total`` where ``most`` allows."""
    low = np.floor(x + 1e-9).astype(np.int64)
    order = np.argsort(-(x - low), kind="stable")
    left = total - int(low.sum())
    for i in order:
        if left <= 0:
            break
        if x[i] > 0 and low[i] < most[i]:
            low[i] += 1
            left -= 1
    return low


def repair(quota: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Raise every number drawn to its minimum, taking from the largest surplus over a minimum."""
    quota = quota.copy()
    need = int(np.maximum(least - quota, 0).sum())
    quota = np.maximum(quota, least)
    while need > 0:
        spare = quota - least
        i = int(np.argmax(spare))
        if spare[i] <= 0:
            break
        step = min(need, max(1, int(spare[i] // 2)))
        quota[i] -= step
        need -= step
    return quota


def rake(counts: np.ndarray, labels: list[np.ndarray], targets: list[np.ndarray], rounds: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Fit cell totals to every margin's targets, never above the rows a cell has.

    labels[m][cell] is the cell's position in margin m and targets[m] that
    margin's totals.  The first margin is fitted last, so it holds exactly
    wherever the cells' rows allow it.
    """
    fit = counts.astype(float).copy()
    for _ in range(rounds):
        old = fit.copy()
        for lab, want in reversed(list(zip(labels, targets, strict=True))):
            have = np.bincount(lab, fit, len(want))
            factor = np.divide(want, have, out=np.zeros_like(have), where=have > 0)
            fit = np.minimum(fit * factor[lab], counts)
        if np.abs(fit - old).max(initial=0) < tol:
            break
    return fit


def target_sample(rows: DataFrame, targets: DataFrame, key: str, category: str = "category", margins: tuple[str, ...] = (), fraction: float = 0.25, seed: int = 7) -> Sampled:
    """Draw ``floor(pool * fraction)`` rows whose category shares follow ``targets``.

    rows: any table with ``key`` and ``category``; rows without a category are
    not in the pool.  targets: top_name, target_share, min_rows.  margins:
    further label columns whose shares in the pool the sample should keep; a
    null label is a label of its own.

    A category with fewer rows than its target gives all it has and the rest
    goes to the other categories in proportion; categories without a target
    give nothing.  Minimums come first: where they add up to more, so does the
    sample.  Repeated rows are separate rows.  An empty pool gives an
    empty sample and a report of zeros.

    rows: the sample.  report: per category of the targets, what was wanted and
    drawn.  margins: for every margin and value its share in the pool and in the
    sample, and the gap in rows; the category's gap is to its target.

    Only the contingency table (labels and counts, see MAX_CELLS) comes to the
    driver.  Rows are drawn by key ``-ln(u) / weight`` through per-category
    thresholds, so a category of any size is never ordered in one task.  What
    the draw lacks in minimums is added in the order of the keys, and taken off
    the end of the categories with the largest surplus.
    """
    require(rows, key, category, *margins)
    spark = rows.sparkSession
    marked = [F.coalesce(F.col(m).cast("string"), F.lit("\0")).alias(f"_m{i}") for i, m in enumerate(margins)]
    # the row travels as one column, so its own column names cannot clash
    pool = rows.where(F.col(category).isNotNull()).select(F.struct(*[F.col(c) for c in rows.columns]).alias("_row"), F.col(key).alias("_key"), F.col(category).alias("_c"), *marked)
    cells = bounded_collect(pool.groupBy("_c", *[f"_m{i}" for i in range(len(margins))]).count(), MAX_CELLS, "cells of the margins")
    want = {r["top_name"]: (float(r["target_share"] or 0), int(r["min_rows"] or 0)) for r in bounded_collect(targets.where("top_name IS NOT NULL"), MAX_CELLS, "targets")}
    n_pool = sum(r["count"] for r in cells)
    size = int(n_pool * fraction)

    names = sorted(want)
    cells = [r for r in cells if r["_c"] in want]
    counts = np.array([r["count"] for r in cells], dtype=np.int64)
    cat = np.array([names.index(r["_c"]) for r in cells], dtype=np.int64)
    have = np.bincount(cat, counts, len(names)).astype(np.int64)
    share = np.array([want[n][0] for n in names])
    least = np.minimum(np.array([want[n][1] for n in names], dtype=np.int64), have)

    quota = whole_numbers(fill_to(share * size, have.astype(float), min(size, int(have.sum()))), have, size) if len(cells) else np.zeros(len(names), dtype=np.int64)
    labels, aims = [cat], [quota.astype(float)]
    for i in range(len(margins)):
        values = sorted({r[f"_m{i}"] for r in cells})
        at = {v: k for k, v in enumerate(values)}
        lab = np.array([at[r[f"_m{i}"]] for r in cells], dtype=np.int64)
        labels.append(lab)
        aims.append(np.bincount(lab, counts, len(values)) / max(1, counts.sum()) * quota.sum())
    fit = rake(counts, labels, aims) if len(cells) else counts.astype(float)
    rate = fit / np.maximum(counts, 1)
    top = np.zeros(len(names))
    np.maximum.at(top, cat, rate)

    fields = [T.StructField("_c", T.StringType()), *[T.StructField(f"_m{i}", T.StringType()) for i in range(len(margins))], T.StructField("_w", T.DoubleType())]
    weights = spark.createDataFrame([(r["_c"], *[r[f"_m{i}"] for i in range(len(margins))], float(max(rate[k] / top[cat[k]], 1e-12)) if top[cat[k]] > 0 else 1.0) for k, r in enumerate(cells)], T.StructType(fields))
    ranked = (
        pool.join(F.broadcast(weights), ["_c", *[f"_m{i}" for i in range(len(margins))]])
        .withColumn("_rank", -F.log(unit_interval(F.col("_key"), F.lit(seed))) / F.col("_w"))
        .withColumn("_one", F.lit(1))
    )

    def draw(numbers):
        quotas = spark.createDataFrame([(n, int(q)) for n, q in zip(names, numbers, strict=True)], "_c string, _q long")
        return take_by_threshold(ranked, ["_c"], "_rank", "_key", "_one", quotas, "_q", scale_free=True)

    first = draw(quota)
    if (quota < least).any():
        # the draw itself says what is missing; keys that are there twice may stand on its edge
        got = {r["_c"]: r["count"] for r in bounded_collect(first.groupBy("_c").count(), MAX_CELLS, "categories")}
        quota = repair(np.array([got.get(n, 0) for n in names], dtype=np.int64), least)
        first = draw(quota)
    drawn = first.select("_row.*")

    base = spark.createDataFrame([(n, want[n][0], want[n][1], int(have[k]), max(float(want[n][1]), want[n][0] * size)) for k, n in enumerate(names)], "top_name string, target_share double, min_rows int, pool_rows long, wanted_rows double")
    got = drawn.groupBy(F.col(category).alias("top_name")).agg(F.count("*").alias("sampled_rows"))
    report = (
        base.join(got, "top_name", "left")
        .withColumn("sampled_rows", F.coalesce("sampled_rows", F.lit(0)))
        .withColumn("actual_share", F.col("sampled_rows") / F.lit(float(max(1, int(quota.sum())))))
        .withColumn("missing_rows", F.greatest(F.lit(0.0), F.col("wanted_rows") - F.col("sampled_rows")))
        .withColumn("met", ~((F.col("pool_rows") < F.col("wanted_rows")) & (F.col("missing_rows") > 0)))
    )
    sides = [(category, F.col("_c")), *[(m, F.col(f"_m{i}")) for i, m in enumerate(margins)]]
    marks = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.nullif(c, F.lit("\0")).alias("value")) for m, c in sides])).alias("_s")
    count = lambda d, n: d.select(marks).groupBy("_s").agg(F.count("*").alias(n)).select("_s.margin", "_s.value", n)
    inside = pool.where(F.col("_c").isin(names)) if names else pool.where("false")
    same = (F.col("margin") == F.col("_margin")) & F.col("value").eqNullSafe(F.col("_value"))
    drawn_by = count(first, "sampled_rows").withColumnsRenamed({"margin": "_margin", "value": "_value"})
    wanted = spark.createDataFrame([(category, n, float(w)) for n, w in zip(names, share, strict=True)], "_wm string, _wv string, _share double")
    aim = F.coalesce("_share", F.col("pool_rows") / F.lit(float(max(1, int(counts.sum())))))
    total = float(max(1, int(quota.sum())))
    table = count(inside, "pool_rows").join(drawn_by, same, "left").join(wanted, (F.col("margin") == F.col("_wm")) & F.col("value").eqNullSafe(F.col("_wv")), "left")
    gaps = table.select("margin", "value", "pool_rows", F.coalesce("sampled_rows", F.lit(0)).alias("sampled_rows"), aim.alias("wanted_share"), (F.coalesce("sampled_rows", F.lit(0)) / F.lit(total)).alias("actual_share"))
    gaps = gaps.withColumn("gap_rows", F.col("sampled_rows") - F.col("wanted_share") * F.lit(total))
    return Sampled(drawn, report, gaps, size, n_pool)
