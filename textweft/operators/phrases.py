"""Common phrases of two normalised texts."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import map_arrow


def common_phrases(a: str, b: str, least: int = 6) -> list[str]:
    """Matching character blocks of at least ``least`` words, sorted, each once."""
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    found = {a[m.a : m.a + m.size].strip() for m in blocks}
    return sorted(p for p in found if len(p.split()) >= least)


def word_grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` words of a collapsed text."""
    w = tokens(text)
    last = F.size(w) - n
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))).otherwise(F.array().cast("array<string>"))


def shares_grams(a: Column, b: Column, n: int) -> Column:
    """Whether both texts have a run of ``n`` words in common."""
    return F.coalesce(F.arrays_overlap(word_grams(a, n), word_grams(b, n)), F.lit(False))


def exact_phrases(pairs: DataFrame, a: str, b: str, out: str = "phrases", least: int = 6) -> DataFrame:
    """Add the common phrases of columns ``a`` and ``b``.

    A phrase of ``least`` words holds least - 2 whole words inside both texts, so
    pairs without a common run of that many words have none and skip the
    matcher; nulls have none.
    """
    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    marked = pairs.withColumn("_may", F.col(a).isNotNull() & F.col(b).isNotNull() & shares_grams(F.col(a), F.col(b), max(1, least - 2)))

    def run(batches):
        import pyarrow as pa

        from textweft.operators.phrases import common_phrases as match

        for batch in batches:
            x, y, may = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b, "_may"))
            found = [match(p, q, least) if m else [] for p, q, m in zip(x, y, may, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=schema.names)

    return map_arrow(marked, run, schema)
