"""Exact similarity joins of a stated query set against all rows.

Both sides are dealt to a grid: queries in blocks, rows in parts, and every
block meets every part in a task of its own, as one matrix product.  Nothing
passes through the driver; only k rows a query and part are shuffled on.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow, ship, stored

#: Queries of a block and rows of a part, about; they bound what a task holds.
BLOCK, PART = 4_096, 32_768


def grid(queries: DataFrame, rows: DataFrame, function, schema, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``function(query table, row table)`` (Arrow) of every block of ``queries`` with every part of ``rows``.

    Both are stored tables.  Places are dealt by the hash of a row's number, so
    equal keys do not gather anywhere.
    """
    spark = rows.sparkSession
    ship(spark)
    blocks, parts = max(1, math.ceil(queries.count() / block)), max(1, math.ceil(rows.count() / part))
    # few rows are still spread over the cores
    parts = max(parts, -(-spark.sparkContext.defaultParallelism // blocks))
    place = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(4 * blocks * parts, 10_000)
    left = queries.withColumn("_b", place(blocks)).withColumn("_p", every(parts)).repartition(tasks, "_b", "_p")
    right = rows.withColumn("_p", place(parts)).withColumn("_b", every(blocks)).repartition(tasks, "_b", "_p")
    return left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInArrow(function, schema)


def best_of(scores: np.ndarray, k: int | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and query positions of all scores (rows x queries) that reach ``least`` and a query's k-th best (without ``k`` all that reach ``least``); ties are kept."""
    if k is not None and scores.shape[0] > k:
        cut = np.partition(scores, scores.shape[0] - k, axis=0)[scores.shape[0] - k]
        return np.nonzero((scores >= cut[None, :]) & (scores >= least))
    return np.nonzero(scores >= least)


def unit_rows(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of the usable rows of an Arrow list column, and their positions."""
    import pyarrow as pa
    import pyarrow.compute as pc

    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    at = np.flatnonzero(np.asarray(fits))
    if not len(at):
        return np.zeros((0, width)), at
    x = pc.fill_null(column.filter(fits).flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], at[good]


def usable_vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(_k, _v): unit vectors, as bytes of doubles, of the rows that have a usable one."""
    schema = T.StructType([T.StructField("_k", rows.schema[key].dataType), T.StructField("_v", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        from textweft.operators.similarity import unit_rows as unit

        for batch in batches:
            x, at = unit(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary())], names=schema.names)

    return map_arrow(rows.where(F.size(vector) == width).select(F.col(key).alias("_k"), vector), run, schema)


def top_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, least: float = -1.0, width: int = 64, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(q, n, cosine, rank): for each query vector the ``k`` most similar rows other than itself, in double precision.

    Vectors that are null, of another width, all zero or not finite take no
    part.  Rows with the query's own key are no neighbours, null keys are like
    others.  Ties go to the smaller key; similarity is clamped to [-1, 1].
    """
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("q", kind), T.StructField("n", kind), T.StructField("cosine", T.DoubleType())])

    def meet(left, right):
        import pyarrow as pa

        from textweft.operators.similarity import best_of as pick

        names = pa.chunked_array([*left.column("_k").chunks, *right.column("_k").chunks], left.schema.field("_k").type).combine_chunks()
        code = np.asarray(names.dictionary_encode(null_encoding="encode").indices)
        mine, theirs = code[: len(left)], code[len(left) :]
        read = lambda t: np.frombuffer(b"".join(t.column("_v").to_pylist()), np.float64).reshape(-1, width)
        a, b = read(left), read(right)
        q, n, cosine = [], [], []
        for i in range(0, len(b), 2048):
            # twelve digits, so that ties do not hang on the order of summation
            s = np.round(b[i : i + 2048] @ a.T, 12)
            s[theirs[i : i + 2048, None] == mine[None, :]] = -2.0
            r, c = pick(s, k, max(least, -1.5))
            q.append(c)
            n.append(r + i + len(left))
            cosine.append(s[r, c])
        flat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table([names.take(pa.array(flat(q, np.int64))), names.take(pa.array(flat(n, np.int64))), pa.array(np.clip(flat(cosine, float), -1.0, 1.0))], names=schema.names)

    found = grid(stored(usable_vectors(queries, key, vector, width)), stored(usable_vectors(rows, key, vector, width)), meet, schema, block, part)
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "n")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_counts(chunks: DataFrame) -> DataFrame:
    """(doc, chunk, words, times, size): hashes of each chunk's distinct words, how often they occur, and the squared norm."""
    schema = T.StructType([T.StructField("doc", chunks.schema["doc"].dataType), *T.StructType.fromDDL("chunk int, words array<bigint>, times array<int>, size bigint").fields])
    hashed = F.transform(F.split("chunk_text", " "), lambda w: F.xxhash64(w))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(2)
            starts = np.asarray(column.offsets)
            word, owner = np.asarray(column.flatten()), np.repeat(np.arange(len(column)), np.diff(starts))
            order = np.lexsort((word, owner))
            word, owner = word[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])])) if len(word) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(word)))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(column)))]).astype(np.int32))
            size = np.bincount(owner[first], times.astype(float) ** 2, len(column)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(word[first])), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))), pa.array(size)], names=schema.names)

    return map_arrow(chunks.where(F.col("chunk_text") != "").select("doc", F.col("chunk_id").alias("chunk"), hashed.alias("_w")), run, schema)


def top_texts(queries: DataFrame, corpus: DataFrame, k: int = 5, least: float = 0.5, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(q_doc, q_chunk, doc, chunk, cosine, rank) by cosine of integer term counts, exact.

    Both sides: doc, chunk_id, chunk_text (normalised words with single spaces).
    Dot products and squared norms are whole numbers, so the result does not
    depend on the order of summation.  Words are told apart by 64-bit hashes.
    Ties go to the smaller doc and chunk.
    """
    w = Window.partitionBy("q_doc", "q_chunk").orderBy(F.desc("cosine"), "doc", "chunk")
    return _scored_texts(queries, corpus, k, least, block, part).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_texts(queries: DataFrame, corpus: DataFrame, least: float, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(q_doc, q_chunk, doc, chunk, cosine): every chunk other than the query itself at ``least`` or above, exact.

    Sides and similarity as in :func:`top_texts`.  Nothing is ranked or cut, so
    a group of n copies gives n - 1 rows for each query in it.
    """
    return _scored_texts(queries, corpus, None, least, block, part).where("NOT (q_doc = doc AND q_chunk = chunk)")


def _scored_texts(queries: DataFrame, corpus: DataFrame, k: int | None, least: float, block: int, part: int) -> DataFrame:
    """The scores at ``least`` or above that are among a query's ``k`` best of a part, or all of them."""
    schema = T.StructType([T.StructField("q_doc", queries.schema["doc"].dataType), T.StructField("q_chunk", T.IntegerType()), T.StructField("doc", corpus.schema["doc"].dataType), T.StructField("chunk", T.IntegerType()), T.StructField("cosine", T.DoubleType())])

    def meet(left, right):
        import pyarrow as pa

        from textweft.operators.similarity import best_of as pick
        from textweft.operators.similarity import counts_of as counts

        left, right = left.combine_chunks(), right.combine_chunks()
        owner, word, times = counts(left)
        order = np.argsort(word, kind="stable")
        owner, word, times = owner[order], word[order], times[order]
        known, edges = np.unique(word, return_index=True)
        edges = np.append(edges, len(word))
        norms = left.column("size").to_numpy().astype(float)
        rows, cols, scores = [], [], []
        for i in range(0, len(right), 512):
            own, w, n = counts(right.slice(i, 512).combine_chunks())
            at = np.searchsorted(known, w)
            at[at == len(known)] = 0
            fits = known[at] == w if len(known) else np.zeros(len(w), bool)
            used, col = np.unique(at[fits], return_inverse=True)
            m = np.zeros((min(512, len(right) - i), len(used)), np.float32)
            m[own[fits], col] = n[fits]
            matrix = np.zeros((len(used), len(norms)), np.float32)
            size = edges[used + 1] - edges[used]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[used], size)
            matrix[np.repeat(np.arange(len(used)), size), owner[inside]] = times[inside]
            theirs = right.column("size").slice(i, 512).to_numpy().astype(float)
            s = (m @ matrix).astype(np.float64) / np.sqrt(theirs[:, None] * norms[None, :])
            r, c = pick(s, k, least)
            rows.append(r + i)
            cols.append(c)
            scores.append(s[r, c])
        flat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        q, r = pa.array(flat(cols, np.int64)), pa.array(flat(rows, np.int64))
        return pa.table([left.column("doc").take(q), left.column("chunk").take(q), right.column("doc").take(r), right.column("chunk").take(r), pa.array(flat(scores, float))], names=schema.names)

    return grid(stored(term_counts(queries)), stored(term_counts(corpus)), meet, schema, block, part)


def counts_of(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word hash and count of every entry of a table of term counts."""
    import pyarrow as pa

    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    first = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    words, times = (first(whole(table.column(c))) for c in ("words", "times"))
    return np.repeat(np.arange(len(words)), np.asarray(words.value_lengths())), np.asarray(words.flatten()), np.asarray(times.flatten()).astype(np.float32)
