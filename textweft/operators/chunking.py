"""Overlapping windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def word_windows(words: Column, size: int = 100, overlap: int = 30, least: int = 20) -> Column:
    """Arrays of ``size`` words, each starting ``size - overlap`` after the last; shorter tails down to ``least``."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap between 0 and size - 1")
    step = size - overlap
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.slice(words, i + 1, size)), lambda w: F.size(w) >= least)


def chunks(rows: DataFrame, text: str, size: int = 100, overlap: int = 30, least: int = 20) -> DataFrame:
    """Explode a normalised ``text`` into chunk_id (from 0), chunk_text and n_words; other columns stay.

    Null and empty texts have no chunk.  A narrow transformation: no shuffle.
    """
    others = [c for c in rows.columns if c != text]
    # the words are a column of their own, so that a text is divided once and not once a window
    # (no filter on nulls: they have no window, and a filter would compute the text twice, before any exchange)
    words = rows.select(*others, tokens(F.col(text)).alias("_words"))
    cut = words.select(*others, F.posexplode(word_windows(F.col("_words"), size, overlap, least)).alias("chunk_id", "_w"))
    return cut.select(*others, "chunk_id", F.array_join("_w", " ").alias("chunk_text"), F.size("_w").alias("n_words"))
