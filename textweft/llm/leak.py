"""Problem 7: held-out passages inside a training corpus.

Size-partitioned MinHash containment search: items and fragments of items are
grouped by length, documents are read in windows that fit each length, and a
window is a candidate for an item where their MinHash values meet in a band.
Candidates are verified by exact containment of shingles, then word by word.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow
from .common import require
from .glyphs import fold

TOKEN = re.compile(r"[^\W_]+")
DIVIDED = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011\u00ad][ \t]*\r?\n\s*(?=[^\W\d_])")
INSIDE = re.compile(r"(?<=[^\W_])-(?=[^\W_])")
TAG_BREAK = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|table|h[1-6])\b[^<>]*>", re.IGNORECASE)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
UNSEEN_COMMAND = re.compile(r"\\(?:cite|ref|eqref|label|begin|end|vspace|hspace|includegraphics)[a-z]*\*?(?:\[[^\]]*\])*\{[^{}]*\}")
COMMAND = re.compile(r"\\[a-zA-Z]+\*?")

#: Items, and words of items, handled in one pass over the documents; more are handled in further passes.
BLOCK, BLOCK_WORDS = 2_000, 1_000_000
#: Bits of the table that sends most unknown shingles away before they are looked up.
SIEVE = 20


def words_of(text: str | None) -> list[str]:
    """The words of a text as read on the page: no case, punctuation, mark-up, line-end division or look-alikes."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub("", TAG_BREAK.sub(" ", text))
    if "\\" in text:
        text = COMMAND.sub(" ", UNSEEN_COMMAND.sub(" ", text))
    if "\n" in text:
        text = DIVIDED.sub("", text)
    text = fold(text)
    if "-" in text:
        text = INSIDE.sub("", text)
    return TOKEN.findall(text.lower())


def bands_for(jaccard: float, recall: float) -> int:
    """Bands of one row needed to meet a pair of that Jaccard similarity with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - jaccard)))


def best_distance(pattern: list[int], text: list[int], most: int) -> bool:
    """Whether some stretch of ``text`` is within ``most`` word edits of the whole ``pattern``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | (1 << i)
    n = len(pattern)
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score <= most:
                return True
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return score <= most


class Partition:
    """Queries of one length class: their shingles, MinHash tables and window size."""

    def __init__(self, width: int, window: int, stride: int, queries: list[tuple[int, int, list[int]]], bands: int, base: int, rng):
        self.width, self.window, self.stride = width, window, stride
        self.item = np.array([i for i, _, _ in queries], np.int32)
        self.offset = np.array([o for _, o, _ in queries], np.int32)
        self.size = np.array([len(w) for _, _, w in queries], np.int32)
        codes = [shingle_codes(np.array(w, np.int64), width, base) for _, _, w in queries]
        self.universe = np.unique(np.concatenate(codes))
        sets = [np.unique(np.searchsorted(self.universe, c)) for c in codes]
        self.first = np.array([np.searchsorted(self.universe, c[0]) for c in codes], np.int32)
        n = len(self.universe)
        self.ranks = np.stack([rng.permutation(n).astype(np.int32) for _ in range(bands)])
        # for every band: rank of a shingle -> the queries whose MinHash it is
        self.lists, self.starts = [], []
        for rank in self.ranks:
            low = np.array([rank[s].min() for s in sets])
            order = np.argsort(low, kind="stable").astype(np.int32)
            self.lists.append(order)
            self.starts.append(np.searchsorted(low[order], np.arange(n + 1)).astype(np.int32))
        self.sets = sets
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(self.universe >> np.uint64(64 - SIEVE)).astype(np.int64)] = True

    def known(self, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``at`` where a shingle of some query starts, and which shingle it is; codes: of the shingles there."""
        may = self.sieve[(codes >> np.uint64(64 - SIEVE)).astype(np.int64)]
        at, codes = at[may], codes[may]
        where = np.searchsorted(self.universe, codes)
        where[where == len(self.universe)] = 0
        right = self.universe[where] == codes
        return at[right], where[right].astype(np.int32)

    def candidates(self, at: np.ndarray, sid: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Windows and queries that meet in a band: (low, high) into ``at`` and the query."""
        # windows of all documents: starts + j * stride as long as the document lasts
        length = ends - starts
        count = np.maximum(1, -(-(length - (self.window - self.stride)) // self.stride))
        doc = np.repeat(np.arange(len(starts)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin = starts[doc] + nth * self.stride
        finish = np.minimum(begin + self.window, ends[doc])
        low = np.searchsorted(at, begin)
        high = np.searchsorted(at, finish - self.width + 1)
        some = high > low
        low, high, begin, finish = low[some], high[some], begin[some], finish[some]
        if not len(low):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        span = np.stack([low, high], 1).ravel()
        found = []
        for rank, order, first in zip(self.ranks, self.lists, self.starts, strict=True):
            least = np.minimum.reduceat(np.append(rank[sid], np.int32(2**31 - 1)), span)[::2]
            a, n = first[least], first[least + 1] - first[least]
            if n.any():
                w = np.repeat(np.arange(len(low)), n)
                k = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                found.append(w.astype(np.int64) * len(self.item) + order[k])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        w, q = pair // len(self.item), pair % len(self.item)
        return low[w], high[w], q, begin[w], finish[w]


def shingle_codes(ids: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit code for every run of ``width`` word ids."""
    n = len(ids) - width + 1
    code = np.zeros(max(0, n), np.uint64)
    for j in range(width):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j].astype(np.uint64) + np.uint64(1)
        code ^= code >> np.uint64(31)
    return code


class Shingles:
    """The runs of known words of all documents of a batch, for each width made once."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, base: int):
        self.ids, self.doc, self.base, self.made = ids, doc, base, {}

    def __getitem__(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a run starts, and its code."""
        if width not in self.made:
            n = max(0, len(self.ids) - width + 1)
            solid = self.doc[:n] == self.doc[len(self.doc) - n :]
            for j in range(width):
                solid &= self.ids[j : n + j] > 0
            at = np.flatnonzero(solid)
            self.made[width] = at, shingle_codes(self.ids, width, self.base)[at]
        return self.made[width]


class Members:
    """Which values belong to which set: one sorted array behind a sieve, instead of a table of sets by values."""

    def __init__(self, sets: list, values: int):
        self.values = values
        self.pairs = np.unique(np.concatenate([np.asarray(s, np.int64) + i * values for i, s in enumerate(sets)] or [np.zeros(0, np.int64)]))
        self.shift = np.uint64(64 - max(8, (16 * len(self.pairs)).bit_length()))
        self.sieve = np.zeros(1 << (64 - int(self.shift)), bool)
        self.sieve[self.place(self.pairs)] = True

    def place(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def has(self, which: np.ndarray, value: np.ndarray) -> np.ndarray:
        pair = which.astype(np.int64) * self.values + value
        out = self.sieve[self.place(pair)]
        at = np.flatnonzero(out)
        where = np.searchsorted(self.pairs, pair[at])
        where[where == len(self.pairs)] = 0
        out[at] = self.pairs[where] == pair[at]
        return out


def ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low..high-1: the range's number and every position in it."""
    n = high - low
    who = np.repeat(np.arange(len(low)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class LeakIndex:
    """Items of one block, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = 12, edits: float = 0.25, whole_from: int = 20, recall: float = 0.995, seed: int = 3):
        self.run, self.edits = run, edits
        self.keys = [k for k, _ in items]
        vocabulary: dict[str, int] = {}
        self.words = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws] for _, ws in items]
        self.vocabulary, self.base = vocabulary, len(vocabulary) + 1
        self.text = np.array([w for ws in self.words for w in ws] or [0], np.int32)
        self.at = np.cumsum([0] + [len(ws) for ws in self.words])
        rng = np.random.default_rng(seed)
        piece = run // 2
        fragments: dict[tuple[int, int], list] = {}
        whole: dict[int, list] = {}
        for i, ws in enumerate(self.words):
            if 0 < len(ws) < run:
                fragments.setdefault((min(5, len(ws)), run), []).append((i, 0, ws))
            elif ws:
                # every run of 2 x piece words holds one aligned piece in full
                for o in range(0, len(ws) - piece + 1, piece):
                    fragments.setdefault((min(5, piece), piece), []).append((i, o, ws[o : o + piece]))
            if len(ws) >= whole_from:
                whole.setdefault(1 << max(5, (len(ws) - 1).bit_length()), []).append((i, 0, ws))
        self.fragments = [Partition(k, 2 * u, u, q, bands_for(1 / (2 * u - k + 1) if u - k + 1 < 2 else 2 / (2 * u - k + 1), recall), self.base, rng) for (k, u), q in sorted(fragments.items())]
        # half of the three-word shingles of a typical edited item are untouched; a fifth is what the bands are tuned for
        self.whole = [Partition(3, 2 * u + u // 4, u, q, bands_for(0.1, recall), self.base, rng) for u, q in sorted(whole.items())]
        self.shingles = [Members(p.sets, len(p.universe)) for p in self.whole]
        self.uses = [Members([self.words[i] for i in p.item], self.base) for p in self.whole]

    def search(self, texts: list[str | None]) -> np.ndarray:
        """Rows (document position, item position) of all leaks in ``texts``."""
        get = self.vocabulary.get
        found = [[get(w, 0) for w in words_of(t)] for t in texts]
        size = np.array([len(w) for w in found], np.int64)
        ids = np.array([w for ws in found for w in ws], np.int32)
        ends = np.cumsum(size)
        starts = ends - size
        doc = np.repeat(np.arange(len(found), dtype=np.int32), size)
        busy = size > 0
        starts, ends = starts[busy], ends[busy]
        if not len(starts) or not self.keys:
            return np.zeros((0, 2), np.int64)
        runs = Shingles(ids, doc, self.base)
        hits = [self.exact_runs(p, runs, ids, doc, starts, ends) for p in self.fragments]
        sure = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        for p, shingles, use in zip(self.whole, self.shingles, self.uses, strict=True):
            more = self.edited(p, shingles, use, runs, ids, doc, starts, ends, sure)
            sure = np.union1d(sure, more)
        return np.stack([sure // len(self.keys), sure % len(self.keys)], 1)

    def exact_runs(self, p: Partition, runs: Shingles, ids, doc, starts, ends) -> np.ndarray:
        at, sid = p.known(*runs[p.width])
        low, high, q, _, _ = p.candidates(at, sid, starts, ends)
        who, k = ragged(low, high)
        right = sid[k] == p.first[q[who]]
        place = np.unique(at[k[right]].astype(np.int64) * len(p.item) + q[who[right]])
        x, q = place // len(p.item), place % len(p.item)
        i = p.item[q].astype(np.int64)
        y = self.at[i] + p.offset[q]
        total = self.stretch(ids, doc, x, y, i, 1, self.run) + self.stretch(ids, doc, x - 1, y - 1, i, -1, self.run)
        good = total >= np.minimum(self.run, self.at[i + 1] - self.at[i])
        return doc[x[good]].astype(np.int64) * len(self.keys) + i[good]

    def stretch(self, ids, doc, x, y, item, step: int, most: int) -> np.ndarray:
        """How many words from (x, y) on are equal, in one direction, up to ``most``."""
        n = np.zeros(len(x), np.int64)
        home = doc[np.clip(x if step > 0 else x + 1, 0, len(doc) - 1)]
        live = np.ones(len(x), bool)
        for j in range(most):
            a, b = x + j * step, y + j * step
            live &= (a >= 0) & (a < len(ids)) & (b >= self.at[item]) & (b < self.at[item + 1])
            ac, bc = np.clip(a, 0, len(ids) - 1), np.clip(b, 0, len(self.text) - 1)
            live &= (doc[ac] == home) & (ids[ac] == self.text[bc])
            if not live.any():
                break
            n += live
        return n

    def edited(self, p: Partition, shingles: Members, use: Members, runs: Shingles, ids, doc, starts, ends, sure) -> np.ndarray:
        at, sid = p.known(*runs[p.width])
        low, high, q, begin, finish = p.candidates(at, sid, starts, ends)
        pair = doc[begin].astype(np.int64) * len(self.keys) + p.item[q]
        new = ~np.isin(pair, sure)
        low, high, q, begin, finish, pair = (v[new] for v in (low, high, q, begin, finish, pair))
        if not len(q):
            return pair
        size = p.size[q]
        edits = (size * self.edits).astype(np.int64)
        # every edit spoils at most three of the three-word shingles
        least = np.maximum(1, size - 2 - 3 * edits)
        keep = high - low >= least
        low, high, q, begin, finish, pair, size, edits, least = (v[keep] for v in (low, high, q, begin, finish, pair, size, edits, least))
        who, k = ragged(low, high)
        held = np.bincount(who, shingles.has(q[who], sid[k]), len(q))
        keep = held >= least
        low, high, q, begin, finish, pair, size, edits = (v[keep] for v in (low, high, q, begin, finish, pair, size, edits))
        who, k = ragged(begin, finish)
        held = np.bincount(who, use.has(q[who], ids[k]) & (ids[k] > 0), len(q))
        keep = held >= size - edits
        out = set()
        for j in np.flatnonzero(keep):
            if int(pair[j]) not in out and best_distance(self.words[p.item[q[j]]], ids[begin[j] : finish[j]].tolist(), int(edits[j])):
                out.add(int(pair[j]))
        return np.array(sorted(out), np.int64)


_MADE: dict = {}


def index_of(name: str, items: list, run: int, edits: float, whole_from: int) -> LeakIndex:
    """The index called ``name``, made once in each worker process."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = LeakIndex(items, run, edits, whole_from)
    return _MADE[name]


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = 12, edits: float = 0.25, whole_from: int = 20) -> DataFrame:
    """(key, item_key) of every document that holds an item, in one stretch.

    That is ``run`` consecutive words of it (or all, if it has fewer), or, for
    items of at least ``whole_from`` words, the whole item with at most the
    part ``edits`` of its words replaced, dropped or added.

    One pass over the documents for every BLOCK items or BLOCK_WORDS words of
    items, without a shuffle; the items of a block travel to the workers, which
    make their index once.  What an index holds grows with the items' words.  Whole texts are read.  Null and
    blank texts hold nothing, items without a word are in no document, repeated
    rows give repeated results only once for each key.
    """
    require(documents, key, text)
    require(items, item_key, item_text)
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("_item", T.IntegerType())])
    source = documents.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    rows = items.where(F.col(item_text).isNotNull()).select(item_key, item_text)
    out, block, number, size = None, [], 0, 0

    def one_pass(block):
        name = uuid.uuid4().hex

        def run_batches(batches):
            import pyarrow as pa

            from textweft.llm.leak import index_of

            index = index_of(name, block, run, edits, whole_from)
            for batch in batches:
                hit = index.search(batch.column(1).to_pylist())
                keys = batch.column(0).take(pa.array(hit[:, 0], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([block[i][0] for i in hit[:, 1]], pa.int32())], names=[key, "_item"])

        return map_arrow(source, run_batches, schema)

    # the place of an item in the block stands for its key, of whatever type
    names = []
    for r in rows.toLocalIterator():
        found = words_of(r[1])
        if found:
            names.append((number, r[0]))
            block.append((number, found))
            number += 1
            size += len(found)
        if len(block) == BLOCK or size >= BLOCK_WORDS:
            part, block, size = one_pass(block), [], 0
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = one_pass(block)
        out = part if out is None else out.unionByName(part)
    lookup = documents.sparkSession.createDataFrame(names, T.StructType([T.StructField("_item", T.IntegerType()), T.StructField(item_key, items.schema[item_key].dataType)]))
    return out.join(lookup, "_item").select(key, item_key).distinct()
