"""Problem 4: the most similar vectors of every vector.

Vectors go to shards by their nearest centroid; every shard builds a
hierarchical navigable small-world graph in flat neighbour arrays, is searched
by its own vectors and by those for which it is among the nearest shards, and
the shards' results are merged.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, checkpoint, group_arrow, map_arrow
from .common import require

#: Vectors the shards' centroids are fitted on, about, and at most twice as many; taken by hash.
SAMPLE = 20_000
#: A shard's rows follow the square root of the whole, between these.
SHARD_ROWS = (20_000, 500_000)


def usable(batch_column, width: int):
    """Unit vectors of the usable rows of an Arrow list column, and which rows those are.

    Usable: not null, ``width`` long, finite, no null inside, not all zero.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(batch_column, pa.ChunkedArray):
        batch_column = batch_column.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(batch_column), width), False)
    at = np.flatnonzero(np.asarray(fits))
    if not len(at):
        return np.zeros((0, width), np.float32), at
    flat = batch_column.filter(fits).flatten()
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), at[good]


def unit_vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(_k, _h, _v): usable vectors as float32 bytes with a hash of them."""
    schema = T.StructType([T.StructField("_k", rows.schema[key].dataType), *T.StructType.fromDDL("_h long, _v binary").fields])

    def run(batches):
        import pyarrow as pa
        import xxhash

        from textweft.llm.knn import usable as check

        for batch in batches:
            x, at = check(batch.column(1), width)
            raw = [v.tobytes() for v in x + np.float32(0)]
            hashes = np.array([xxhash.xxh3_64_intdigest(b) for b in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(hashes), pa.array(raw, pa.binary())], names=schema.names)

    return map_arrow(rows.where(F.size(vector) == width).select(F.col(key).alias("_k"), vector), run, schema)


def centroids(x: np.ndarray, k: int, most: float | None = None, rounds: int = 12, seed: int = 4) -> np.ndarray:
    """Spherical k-means of a sample; an empty cell is moved to a random vector.

    Cells that hold more than ``most`` of the sample are then halved by two
    means of their own, until none does or its vectors cannot be told apart.
    """
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        a = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), x[rng.integers(0, len(x), len(c))])
    a = (x @ c.T).argmax(1)
    todo, done = [x[a == i] for i in range(len(c))], []
    while todo:
        y = todo.pop()
        if len(y) <= max(1, most or len(x)):
            done.append(y)
            continue
        two = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(rounds):
            gap = y @ (two[0] - two[1])
            side = gap > np.median(gap)
            if side.all() or not side.any():
                break
            two = np.stack([y[side].mean(0), y[~side].mean(0)])
        if side.all() or not side.any():
            done.append(y)
        else:
            todo += [y[side], y[~side]]
    means = np.stack([y.mean(0) for y in done if len(y)])
    return (means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def search_shard(table, width: int, k: int, build: int, ef: int, least: float):
    """Build one shard's graph and answer all that came to it; what guests find counts for both sides."""
    import pyarrow as pa

    from .hnsw import Hierarchy

    keys = table.column("_k").combine_chunks()
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.chunk(0)
    home = np.asarray(table.column("_home").to_numpy(zero_copy_only=False), dtype=bool)
    raw = table.column("_v").combine_chunks()
    x = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, width)
    inside, guests = np.flatnonzero(home), np.flatnonzero(~home)
    graph = Hierarchy(x[inside], build=build, keep=k + 1)
    pos, sim = np.full((len(x), k + 1), -1, np.int64), np.zeros((len(x), k + 1), np.float32)
    # guests are named by numbers behind those of the points
    found, sim[guests] = graph.query(x[guests], k + 1, ef, names=len(inside) + np.arange(len(guests)))
    pos[guests], (pos[inside], sim[inside]) = found, graph.neighbours()
    real = (pos >= 0) & (sim >= least)
    q, c = np.nonzero(real)
    near = np.concatenate([inside, guests])[pos[q, c]]
    return pa.table([keys.take(pa.array(q)), keys.take(pa.array(near)), pa.array(sim[q, c].astype(np.float64))], names=["q", "n", "cosine"])


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, k: int = 5, least: float = -1.0, probes: int | None = None, ef: int = 12, build: int = 24, shard_rows: int | None = None) -> DataFrame:
    """(key, neighbour, cosine, rank): the ``k`` most similar other vectors of every vector.

    Vectors that are null, not ``width`` long, all zero or hold a null, NaN or
    infinite value take no part.  Equal vectors are searched once and are one
    another's neighbours with cosine 1; ties go to the smaller key; a row without
    a key is no one's neighbour and has none.  least: keep
    only neighbours at least that similar (a cut below which nothing changes,
    made before the shuffle).  An empty table gives none.

    Approximate: every vector is a point of the graph of its own shard, which
    keeps ``build`` candidates an insertion, and asks the graphs of the next
    shards, ``probes`` in all (0.6 times the square root of their number, at
    least two), with ``ef`` candidates; a pair that either side finds counts for
    both.  Centroids are fitted on SAMPLE vectors; every vector is indexed.
    Cells of more than 1.5 shards' rows are halved; a shard whose guests outnumber
    its rows by far is searched by several tasks, each with its own graph.
    """
    require(rows, key, vector)
    vec = checkpoint(unit_vectors(rows, key, vector, width))
    total = vec.count()
    classes = vec.groupBy("_h").agg(F.min("_k").alias("_rep"), F.count("*").alias("_n")).where("_n > 1")
    members = checkpoint(attach(vec.select("_k", "_h"), classes.select("_h", "_rep"), "_h").select("_k", "_rep").distinct())
    single = attach(vec, members.where("_k <> _rep").select("_k").distinct(), "_k", "left_anti")

    size = shard_rows or int(min(SHARD_ROWS[1], max(SHARD_ROWS[0], 40 * math.sqrt(total))))
    picked = single.where(F.pmod(F.xxhash64("_k"), F.lit(max(1, total // SAMPLE))) == 0).limit(2 * SAMPLE).select("_v").collect()
    x = np.frombuffer(b"".join(bytes(r["_v"]) for r in picked), np.float32).reshape(-1, width)
    share = size / max(1, total) * len(x)
    centre = centroids(x, max(1, math.ceil(total / size)), 1.5 * share) if len(x) else np.zeros((1, width), np.float32)
    asked = min(len(centre), probes or max(2, round(0.6 * math.sqrt(len(centre)))))
    guests = np.bincount(np.argsort(-(x @ centre.T), axis=1)[:, 1:asked].ravel(), minlength=len(centre))
    parts = np.maximum(1, np.ceil(guests / max(1.0, 2.5 * share))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(parts)])

    key_type = vec.schema["_k"].dataType
    routed = T.StructType([T.StructField("_shard", T.IntegerType()), T.StructField("_home", T.BooleanType()), T.StructField("_k", key_type), T.StructField("_v", T.BinaryType())])

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, width)
            cell = np.argsort(-(v @ centre.T), axis=1)[:, :asked]
            mine, other = cell[:, 0], cell[:, 1:].ravel()
            # at home in every part of the own cell, a guest in one part of the others
            n = parts[mine]
            who = np.concatenate([np.repeat(np.arange(len(v)), n), np.repeat(np.arange(len(v)), cell.shape[1] - 1)])
            own = np.repeat(first[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sub = batch.column(1).to_numpy().view(np.uint64).repeat(cell.shape[1] - 1) % parts[other].astype(np.uint64)
            shard = np.concatenate([own, first[other] + sub.astype(np.int64)])
            home = np.arange(len(who)) < len(own)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(home), batch.column(0).take(take), batch.column(2).take(take)], names=routed.names)

    # several tasks for each shard's place, so that two seldom share one
    sent = map_arrow(single.select("_k", "_h", "_v"), route, routed).repartition(int(min(4 * first[-1], 10_000)), "_shard")
    out = T.StructType([T.StructField("q", key_type), T.StructField("n", key_type), T.StructField("cosine", T.DoubleType())])

    def search(table):
        from textweft.llm.knn import search_shard as run

        return run(table, width, k, build, ef, least)

    found = group_arrow(sent.groupBy("_shard"), sent, search, out)

    # copies: their first keys stand for them, as many as a list can hold
    w = Window.partitionBy("_rep").orderBy("_k")
    firsts = checkpoint(members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).groupBy("_rep").agg(F.sort_array(F.collect_list("_k")).alias("_ids")))
    opened = found.join(firsts.select(F.col("_rep").alias("n"), "_ids"), "n", "left").select("q", F.explode(F.coalesce("_ids", F.array("n"))).alias("n"), "cosine")
    own = firsts.select(F.col("_rep").alias("q"), F.explode("_ids").alias("n"), F.lit(1.0).alias("cosine")).where(F.lit(1.0 >= least))
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "n")
    # a key that is there twice is one neighbour
    once = opened.unionByName(own).repartition("q").groupBy("q", "n").agg(F.max("cosine").alias("cosine"))
    listed = once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    everyone = listed.join(members.select(F.col("_rep").alias("q"), F.col("_k").alias("_m")), "q", "left").select(F.coalesce("_m", "q").alias("q"), "n", "cosine").where("q <> n")
    return everyone.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("q").alias(key), F.col("n").alias("neighbour"), F.least(F.lit(1.0), "cosine").alias("cosine"), "rank")
