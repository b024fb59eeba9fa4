"""Problem 2: cutting oversized texts at natural boundaries.

A sparse table over the strengths of a text's boundaries answers "strongest
cut in this window" in constant time; ties go to the right, and the next
piece starts one overlap before the cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow
from .common import require

SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
SENTENCE = np.array([ord(c) for c in ".!?。！？"], dtype=np.uint32)
CLAUSE = np.array([ord(c) for c in ",;:，；：、)]"], dtype=np.uint32)
WIDE_STOPS = np.array([ord(c) for c in "。！？，；：、"], dtype=np.uint32)


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a text may be cut (before that character) and how strong each is.

    6 blank line, 5 sentence end, 4 line end, 3 clause end, 2 blank, 1 hyphen.
    """
    n = len(codes)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    space = np.isin(codes, SPACES)
    wide = np.isin(codes, WIDE_STOPS)
    hyphen = codes == 45
    at = np.flatnonzero(~space[1:] & (space[:-1] | wide[:-1] | hyphen[:-1])) + 1
    at = at[~np.isin(codes[at], WIDE_STOPS)]
    # the last character that is no blank, before each position
    seen = np.where(space, 0, np.arange(1, n + 1))
    last = np.maximum.accumulate(seen)[at - 1]
    before = codes[np.maximum(last, 1) - 1]
    breaks = np.concatenate([[0], np.cumsum(codes == 10)])
    lines = breaks[at] - breaks[last]
    gap = at > last
    strength = np.where(gap, 2, 1).astype(np.int8)
    strength[np.isin(before, CLAUSE) & (gap | np.isin(before, WIDE_STOPS))] = 3
    strength[lines >= 1] = 4
    strength[np.isin(before, SENTENCE) & (gap | np.isin(before, WIDE_STOPS))] = 5
    strength[lines >= 2] = 6
    return at.astype(np.int64), strength


class RangeMaximum:
    """Index of the rightmost maximum of a range, by a sparse table of int32."""

    def __init__(self, values: np.ndarray, widest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while width * 2 <= min(widest, len(values)):
            a = self.levels[-1]
            left, right = a[: len(a) - width], a[width:]
            self.levels.append(np.where(values[right] >= values[left], right, left))
            width *= 2

    def query(self, low: int, high: int) -> int:
        """Of positions low..high, both included; -1 if there is none."""
        if high < low:
            return -1
        k = min((high - low + 1).bit_length() - 1, len(self.levels) - 1)
        a, b = int(self.levels[k][low]), int(self.levels[k][high - (1 << k) + 1])
        return b if self.values[b] >= self.values[a] else a


def cut(text: str, limit: int = 1200, overlap: int = 200, slack: int = 40) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``; every piece is at most ``limit`` characters.

    A piece ends at the strongest boundary of the second half of what the
    limit allows, or at the limit where that half has none.  The next starts
    ``overlap`` before it, moved by at most ``slack`` to a boundary.  A text
    within the limit is one piece; an empty one has none.
    """
    if not 0 <= overlap + slack < limit // 2:
        raise ValueError("overlap and slack must stay below half the limit")
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    at, strength = boundaries(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    index = RangeMaximum(strength, limit)
    out, start = [], 0
    while n - start > limit:
        low, high = np.searchsorted(at, [start + limit // 2, start + limit + 1])
        k = index.query(int(low), int(high) - 1)
        end = int(at[k]) if k >= 0 else start + limit
        out.append((start, end))
        low, high = np.searchsorted(at, [end - overlap - slack, end - overlap + slack + 1])
        k = index.query(int(low), int(high) - 1)
        start = int(at[k]) if k >= 0 else end - overlap
    out.append((start, n))
    return out


def split_oversized(rows: DataFrame, text: str = "text", limit: int = 1200, overlap: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every row whose ``text`` has more than ``limit`` characters.

    keep: the columns each piece takes over from its row.  Adds piece_no (from
    0), n_pieces, piece_start, piece_end (code points) and piece_text.  Rows
    with a null, empty or small enough text give no piece; equal rows give equal
    pieces each.  One narrow pass without a shuffle, whole texts.
    """
    require(rows, text, *keep)
    kept = [rows.schema[c] for c in keep]
    schema = T.StructType([*kept, *T.StructType.fromDDL("piece_no int, n_pieces int, piece_start long, piece_end long, piece_text string").fields])
    source = rows.where(F.length(text) > limit).select(*keep, F.col(text).alias("_text"))

    def run(batches):
        import pyarrow as pa

        from textweft.llm.split import cut as pieces_of

        for batch in batches:
            take, cols = [], ([], [], [], [], [])
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spans = pieces_of(t, limit, overlap)
                for k, (a, b) in enumerate(spans):
                    take.append(i)
                    for c, v in zip(cols, (k, len(spans), a, b, t[a:b]), strict=True):
                        c.append(v)
            old = pa.table(batch).take(pa.array(take, pa.int64()))
            new = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            out = pa.table([*[old.column(i) for i in range(batch.num_columns - 1)], *new], names=schema.names)
            yield from out.combine_chunks().to_batches()

    return map_arrow(source, run, schema)
