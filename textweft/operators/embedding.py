"""Texts as vectors: any model that maps a list of texts to a matrix can be plugged in."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow


@dataclass(frozen=True)
class Embedder:
    """A named model; ``load`` runs once in each worker and gives the function texts -> matrix of ``width`` columns."""

    name: str
    width: int
    load: Callable[[], Callable[[list[str]], np.ndarray]]


def bucket(word: str, width: int) -> int:
    """Which column a word counts in: the first four hexadecimal digits of its md5, modulo ``width``."""
    return int(md5(word.encode()).hexdigest()[:4], 16) % width


def hashed_counts(width: int) -> Callable[[list[str]], np.ndarray]:
    known: dict[str, int] = {}

    def encode(texts: list[str]) -> np.ndarray:
        if len(known) > 2_000_000:
            known.clear()
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w, n in Counter(t.split()).items():
                b = known.get(w)
                if b is None:
                    b = known[w] = bucket(w, width)
                out[i, b] += n
        return out

    return encode


def hashed_terms(width: int = 256) -> Embedder:
    """The default: how often words occur, by hashed column.  Counts are whole numbers, so cosines are exact."""
    return Embedder(f"hashed-term-frequency-{width}", width, partial(hashed_counts, width))


def embed(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding", unit: bool = False, batch_size: int = 512) -> DataFrame:
    """Add ``out``, the vector of ``text`` (array of float, null for a null text); with ``unit`` of length 1, unless it is zero.

    One narrow pass; the model sees ``batch_size`` texts at once.
    """
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != out], T.StructField(out, T.ArrayType(T.FloatType()))])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        import pyarrow as pa

        encode = embedder.load()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            x = np.zeros((len(at), embedder.width))
            for a in range(0, len(at), batch_size):
                x[a : a + batch_size] = encode([texts[i] for i in at[a : a + batch_size]])
            if unit:
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, norm, out=x, where=norm > 0)
            have = np.zeros(len(texts), bool)
            have[at] = True
            edges = np.concatenate([[0], np.cumsum(have)]) * embedder.width
            column = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x.ravel().astype(np.float32)), mask=pa.array(~have))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=schema.names)

    return map_arrow(rows.select(*kept, F.col(text).alias("_text")), run, schema)
