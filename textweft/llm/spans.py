"""Problem 5: long passages that stand word for word in several records.

Texts are cut into content-anchored paragraphs; equal ones are sought, so one
hash of their characters meets them all, and runs are verified on the stored
characters.  Texts that are nearly equal as a whole meet by bands tuned for high
recall and are verified by exact Jaccard similarity.  What is removed is
clustered by connected components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, map_arrow, only, stored
from .common import require
from .graph import components
from .leak import bands_for
from .overlap import WordHashes, paper_number

ODD = np.uint64(0x9E3779B97F4A7C15)
GRAM = 8
#: Paragraphs or different texts of one band that are compared in one place; more are spread over several.
HOT = 20_000
#: Characters handled at once in a worker.
AT_ONCE = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the ``k`` characters from each position on."""
    n = len(codes) - k + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(k):
        h = h * ODD + codes[j : n + j]
    return mix(h)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by running minima of blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    most = np.iinfo(x.dtype).max
    padded = np.full(-(-(len(x)) // width) * width + width, most, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(hashes: np.ndarray, codes_starts: np.ndarray, codes_ends: np.ndarray, run: int, paragraph: int) -> np.ndarray:
    """Paragraph starts: in any ``run`` equal characters of two texts, both get at least one, at the same place.

    In every window of run - paragraph + 1 starts the one with the smallest
    hash is an anchor, the last of equal ones.
    """
    width = run - paragraph + 1
    n = len(hashes)
    place = np.arange(n, dtype=np.uint64) & np.uint64((1 << 24) - 1)
    key = (hashes & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - place)
    least = sliding_minimum(key, width)
    live = np.zeros(len(least), bool)
    for a, b in zip(codes_starts, codes_ends, strict=True):
        if b - a >= run:
            live[a : b - run + 1] = True
    first = np.flatnonzero(live)
    low = np.uint64((1 << 24) - 1) - (least[first] & np.uint64((1 << 24) - 1))
    offset = (low - place[first]) & np.uint64((1 << 24) - 1)
    return np.unique(first + offset.astype(np.int64))


def batches_of(texts: list[str], most: int = AT_ONCE):
    """Index ranges of texts that together have about ``most`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and each text's start and end."""
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends - size, ends


def paragraphs(rows: DataFrame, run: int, paragraph: int, once: bool = False) -> DataFrame:
    """(_k, _paper, band, pos, again) of each anchored paragraph of the texts long enough to hold a run; equal paragraphs have one band.

    The band is a hash of all characters of the paragraph, so that paragraphs that are merely alike, of which there are
    ever more in larger tables, don't meet.
    once: of a paragraph that a text holds several times, the first place only; ``again`` tells that there are more.
    """
    schema = T.StructType([rows.schema["_k"], rows.schema["_paper"], *T.StructType.fromDDL("band long, pos int, again boolean").fields])

    def cut(batches):
        import pyarrow as pa

        from textweft.llm import spans as s

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in s.batches_of(texts):
                codes, starts, ends = s.joined(texts[a:b])
                hashes = s.gram_hashes(codes)
                at = s.anchors(hashes, starts, ends, run, paragraph)
                keys = s.run_hashes(codes, paragraph)[at]
                doc = np.searchsorted(ends, at, side="right")
                again = np.zeros(len(at), bool)
                if once and len(at):
                    order = np.lexsort((at, keys, doc))
                    key, owner = keys[order], doc[order]
                    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
                    again = np.diff(np.append(first, len(order))) > 1
                    first = order[first]
                    at, keys, doc = at[first], keys[first], doc[first]
                who = pa.array(doc + a)
                pos = (at - starts[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(keys.view(np.int64)), pa.array(pos), pa.array(again)], names=schema.names)

    return map_arrow(rows.select("_k", "_paper", "_text"), cut, schema)


def prepare(rows: DataFrame, key: str, ident: str, text: str, run: int) -> DataFrame:
    require(rows, key, ident, text)
    return rows.where(F.length(text) >= run).select(F.col(key).alias("_k"), F.xxhash64(paper_number(F.col(ident))).alias("_paper"), F.col(ident).isNotNull().alias("_has"), F.col(text).alias("_text")).where("_has").drop("_has")


def meeting(parts: DataFrame) -> DataFrame:
    """Paragraphs whose band key occurs in more than one paper, with the number of places to compare them in."""
    shared = parts.groupBy("band").agg(F.min("_paper").alias("_low"), F.max("_paper").alias("_high"), F.count("*").alias("_n")).where("_low <> _high")
    return attach(parts, shared.select("band", F.ceil(F.col("_n") / HOT).cast("int").alias("_places")), "band")


def sharing_pairs(rows: DataFrame, key: str = "row_id", ident: str = "arxiv_id", text: str = "text", run: int = 200, longest: bool = False) -> DataFrame:
    """(a, b): rows of two papers that have a run of at least ``run`` characters in common, smaller key first.

    With ``longest`` also start_a, start_b and length of their longest common
    run, the first in a and then in b of equally long ones.  Null ids name no
    paper; null, empty and shorter texts share nothing; repeated rows share like
    others.  A paragraph that a text repeats meets others once, so texts that
    repeat themselves make no more pairs than others; pairs are verified on the
    stored characters.
    """
    base = prepare(rows, key, ident, text, run)
    some = meeting(stored(paragraphs(base, run, run // 2, once=True)))
    left = some.select("band", F.pmod(F.hash("_k"), "_places").alias("_place"), F.col("_k").alias("a"), F.col("_paper").alias("pa"), F.col("pos").alias("x"), F.col("again").alias("ga"))
    right = some.select("band", F.explode(F.sequence(F.lit(0), F.col("_places") - 1)).alias("_place"), F.col("_k").alias("b"), F.col("_paper").alias("pb"), F.col("pos").alias("y"), F.col("again").alias("gb"))
    # where their common paragraphs stand first in both; all paragraphs of one run lie on one diagonal
    spots = F.sort_array(F.collect_set(F.struct((F.col("x") - F.col("y")).alias("shift"), "x")))
    met = stored(left.join(right, ["band", "_place"]).where("a < b AND pa <> pb").groupBy("a", "b").agg(spots.alias("spots"), F.bool_or(F.col("ga") | F.col("gb")).alias("again")))
    # most rows share nothing: their texts stay where they are; of equal texts one is compared for all, so that copies move no text a pair
    named = met.select(F.col("a").alias("_k")).union(met.select("b")).distinct()
    texts = only(base.select("_k", "_text"), named, "_k").select("_k", F.unhex(F.md5("_text")).alias("_c"), "_text")
    kinds = stored(texts.select("_k", "_c").distinct())
    for side in ("a", "b"):
        met = attach(met, kinds.select(F.col("_k").alias(side), F.col("_c").alias("c" + side)), side)
    pairs = met.groupBy("ca", "cb").agg(F.array_distinct(F.flatten(F.collect_set("spots"))).alias("spots"), F.bool_or("again").alias("again"))
    texts = texts.dropDuplicates(["_c"])
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("_c").alias("c" + side), F.col("_text").alias("t" + side)), "c" + side)
    full = pairs.select("ca", "cb", "ta", "tb", F.col("spots.shift").alias("shifts"), F.col("spots.x").alias("xs"), "again")
    more = T.StructType.fromDDL("start_a int, start_b int, length int").fields if longest else []
    schema = T.StructType([full.schema["ca"], full.schema["cb"], *more])

    def verify(batches):
        import pyarrow as pa

        from textweft.llm.spans import common_run, longest_run, reach

        for batch in batches:
            take, places = [], []
            for i, (ta, tb, shifts, xs, again) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 7)), strict=True)):
                found = any(reach(ta, tb, x, x - shift) >= run for shift, x in zip(shifts, xs, strict=True))
                # first places decide unless a paragraph stands in a text several times
                if (longest and found) or (again and not found):
                    found = longest_run(ta, tb, run) if longest else common_run(ta, tb, run)
                if found:
                    take.append(i)
                    places.append(found)
            at = pa.array(take, pa.int64())
            spans = [pa.array(c, pa.int32()) for c in (zip(*places, strict=True) if places else ([], [], []))] if longest else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *spans], names=schema.names)

    # repeated rows bring a pair several times
    return attach(met, map_arrow(full, verify, schema), ["ca", "cb"]).select("a", "b", *[f.name for f in more]).distinct()


def reach(a: str, b: str, i: int, j: int) -> int:
    """Length of the run of equal characters of ``a`` and ``b`` through a[i] and b[j]."""

    def same(equal, most):
        low, step = 0, 64
        while low < most and equal(low, min(most, low + step)):
            low = min(most, low + step)
            step *= 2
        high = min(most, low + step)
        while low < high:
            mid = (low + high + 1) // 2
            if equal(low, mid):
                low = mid
            else:
                high = mid - 1
        return low

    right = same(lambda p, q: a[i + p : i + q] == b[j + p : j + q], min(len(a) - i, len(b) - j))
    return right and right + same(lambda p, q: a[i - q : i - p] == b[j - q : j - p], min(i, j))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def common_run(a: str, b: str, run: int) -> tuple[int, int, int] | None:
    """Where ``run`` equal characters begin in ``a`` and, after that, in ``b``, with their number; none if there are none."""
    if min(len(a), len(b)) < run:
        return None
    x, y = run_hashes(code_points(a), run), run_hashes(code_points(b), run)
    places, first = np.unique(y, return_index=True)
    where = np.searchsorted(places, x)
    where[where == len(places)] = 0
    for i in np.flatnonzero(places[where] == x).tolist():
        j = int(first[where[i]])
        if a[i : i + run] == b[j : j + run]:
            return i, j, run
    return None


def longest_run(a: str, b: str, run: int) -> tuple[int, int, int] | None:
    """:func:`common_run` of the greatest length, at least ``run``."""
    best = common_run(a, b, run)
    low, high = run, min(len(a), len(b))
    while best and low < high:
        mid = (low + high + 1) // 2
        found = common_run(a, b, mid)
        if found:
            best, low = found, mid
        else:
            high = mid - 1
    return best


def run_hashes(codes: np.ndarray, run: int) -> np.ndarray:
    """Hash of the ``run`` characters from each position on, by prefix sums modulo 2**64."""
    n = len(codes) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), ODD, np.uint64)]))
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes.astype(np.uint64) + ODD) * powers[:-1], dtype=np.uint64)])
    return mix((sums[run:] - sums[:n]) * back)


def shared_runs(rows: DataFrame, key: str, ident: str, text: str, run: int) -> DataFrame:
    """(_k, pos, h): starts of ``run`` characters that also stand in another paper, without making pairs.

    Only rows with a paragraph that meets another paper's are looked at again,
    and of those only the runs that hold such a paragraph.
    """
    base = prepare(rows, key, ident, text, run)
    some = meeting(stored(paragraphs(base, run, run // 2)))
    hits = some.groupBy("_k").agg(F.collect_set("pos").alias("_at"))
    source = only(base, some.select("_k").distinct(), "_k").join(hits, "_k").select("_k", "_paper", "_text", "_at")
    schema = T.StructType([base.schema["_k"], base.schema["_paper"], *T.StructType.fromDDL("pos int, h long").fields])
    back = run - run // 2

    def cut(batches):
        import pyarrow as pa

        from textweft.llm import spans as s

        for batch in batches:
            for i, (t, at) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                h = s.run_hashes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), run)
                live = np.zeros(len(h), bool)
                for p in at:
                    live[max(0, p - back) : p + 1] = True
                pos = np.flatnonzero(live)
                who = pa.array(np.full(len(pos), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(pos.astype(np.int32)), pa.array(h[pos].view(np.int64))], names=schema.names)

    runs = stored(map_arrow(source, cut, schema))
    shared = runs.groupBy("h").agg(F.min("_paper").alias("_low"), F.max("_paper").alias("_high"), F.min("_k").alias("_first")).where("_low <> _high").select("h", "_first")
    return runs.join(shared, "h").select("_k", "pos", "h", "_first")


def shared_spans(rows: DataFrame, key: str = "row_id", ident: str = "arxiv_id", text: str = "text", run: int = 200) -> DataFrame:
    """(key, start, length): maximal stretches of a row whose every ``run`` characters stand in another paper too."""
    at = shared_runs(rows, key, ident, text, run).select("_k", "pos").distinct()
    w = Window.partitionBy("_k").orderBy("pos")
    islands = at.withColumn("_new", (F.col("pos") > F.coalesce(F.lag("pos").over(w), F.lit(-2)) + 1).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy("_k", "_island").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + run).alias("length")).select(F.col("_k").alias(key), "start", "length")


def shared_shares(rows: DataFrame, key: str = "row_id", ident: str = "arxiv_id", text: str = "text", run: int = 200) -> DataFrame:
    """(key, n_chars, shared_chars, share) of every row; rows that share nothing, or have no text, have 0."""
    spans = shared_spans(rows, key, ident, text, run)
    w = Window.partitionBy(key).orderBy("start")
    # stretches of one row may overlap by less than a run
    reach = F.coalesce(F.lag(F.col("start") + F.col("length")).over(w), F.lit(0))
    sums = spans.withColumn("_n", F.col("length") - F.greatest(F.lit(0), reach - F.col("start"))).groupBy(key).agg(F.sum("_n").alias("shared_chars"))
    size = F.coalesce(F.length(text), F.lit(0))
    return rows.select(key, size.alias("n_chars")).join(sums, key, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0))).withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))


def removal_clusters(rows: DataFrame, key: str = "row_id", ident: str = "arxiv_id", text: str = "text", run: int = 200) -> DataFrame:
    """(key, cluster_id, kept) of rows joined by shared runs; the smallest key of a cluster is kept.

    Each run links its rows to the first of them, so links grow with rows and not with pairs.
    """
    links = shared_runs(rows, key, ident, text, run).select(F.col("_k").alias("a"), F.col("_first").alias("b")).where("a <> b").distinct()
    return components(links).select(F.col("node").alias(key), F.col("component").alias("cluster_id"), (F.col("node") == F.col("component")).alias("kept"))


def shingle_sets(texts: list[str | None], known: WordHashes, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of all texts, each text's sorted and once, and how many each has.

    Words are lower-cased and divided by white space; a text with fewer words
    than ``width`` is one run.
    """
    words = [[known[w] for w in t.lower().split()] if t else [] for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    flat = np.array([h for w in words for h in w] + [0] * width, np.uint64)
    n = np.where(size > 0, np.maximum(1, size - width + 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(size) - size, n)
    reach = np.minimum(width, size)[owner]
    code = np.zeros(len(at), np.uint64)
    for j in range(width):
        code = np.where(j < reach, mix(code * ODD + flat[at + j] + np.uint64(1)), code)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    first = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, bool)
    return code[first], np.bincount(owner[first], minlength=len(texts))


def near_rows(rows: DataFrame, key: str = "row_id", text: str = "text", similarity: float = 0.8, recall: float = 0.9999, per_band: int = 4, seed: int = 5) -> DataFrame:
    """(key, cluster_id, links) of every row with a text: rows joined by nearly equal texts, and to how many other texts each is linked.

    Two texts are linked if their sets of five-word runs have ``similarity`` in
    common, exactly compared; a pair at just that similarity is met with
    probability ``recall``, the number of bands follows from it.  Equal texts
    (but for case and white space) are one text; a text with no link is a
    cluster of its own, named by its smallest key.  Null and blank texts have no
    row; repeated rows give one each.

    Texts of a band are compared where they meet, by the bits of their sketches,
    which drops no linked pair, so only pairs that may be linked are moved; a
    band of more than HOT texts is compared in several places.
    """
    require(rows, key, text)
    plain = F.lower(F.trim(F.regexp_replace(F.col(text), r"(?U)[\s\x1c-\x1f]+", " ")))
    named = rows.where(plain != "").select(F.col(key).alias("_k"), F.xxhash64(plain).alias("_c"), F.monotonically_increasing_id().alias("_i"), F.col(text).alias("_x"))
    members = named.groupBy("_c").agg(F.min("_k").alias("_low"))
    # of equal texts the first row stands for all; most stand alone and are not moved
    copies = named.groupBy("_c").agg(F.min("_i").alias("_rep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    single = attach(named, copies, "_c", "left").where("_rep IS NULL OR _i = _rep").select("_c", "_x")
    bands = bands_for(similarity**per_band, recall)

    def cut(batches):
        import pyarrow as pa

        from textweft.llm import spans as s

        known = s.WordHashes()
        rng = np.random.default_rng(seed)
        salts = rng.integers(1, 1 << 63, (bands, per_band)).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            codes, n = s.shingle_sets(batch.column(1).to_pylist(), known)
            if not len(codes):
                continue
            starts = np.cumsum(n) - n
            keys = np.zeros((len(n), bands), np.uint64)
            for b in range(bands):
                for salt in salts[b]:
                    keys[:, b] = s.mix(keys[:, b] * s.ODD + np.minimum.reduceat(s.mix(codes * salt), starts) + np.uint64(b))
            bit, second = np.uint64(1) << (codes & np.uint64(63)), (codes & np.uint64(64)) > 0
            sketch = [np.bitwise_or.reduceat(np.where(side, bit, np.uint64(0)), starts).view(np.int64) for side in (~second, second)]
            ends = pa.array(np.append(starts, len(codes)).astype(np.int32))
            edges = pa.array((np.arange(len(n) + 1) * bands).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(codes.view(np.int64))), pa.array(n.astype(np.int32)), *[pa.array(x) for x in sketch], pa.ListArray.from_arrays(edges, pa.array(keys.ravel().view(np.int64)))], names=["_c", "runs", "n", "s1", "s2", "bands"])

    texts = stored(map_arrow(single, cut, "_c long, runs array<bigint>, n int, s1 bigint, s2 bigint, bands array<bigint>"))
    banded = texts.select("_c", "n", "s1", "s2", F.explode("bands").alias("_b"))
    sizes = banded.groupBy("_b").agg(F.count("*").alias("_t")).where("_t > 1").select("_b", F.ceil(F.col("_t") / HOT).cast("int").alias("_places"))
    met = stored(attach(banded, sizes, "_b"))
    side = lambda n: [F.col(c).alias(n + c) for c in ("_c", "n", "s1", "s2")]
    a = met.select("_b", F.pmod(F.hash("_c"), "_places").alias("_place"), *side("a"))
    b = met.select("_b", F.explode(F.sequence(F.lit(0), F.col("_places") - 1)).alias("_place"), *side("b"))
    # similar sets differ in few runs, so in few bits of their sketches, and are of like size
    most = (F.col("an") + F.col("bn")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    differ = F.bit_count(F.col("as1").bitwiseXOR(F.col("bs1"))) + F.bit_count(F.col("as2").bitwiseXOR(F.col("bs2")))
    near = (F.col("a_c") < F.col("b_c")) & (differ <= most) & (F.least("an", "bn") >= F.greatest("an", "bn") * F.lit(similarity - 1e-9))
    pairs = stored(a.join(b, ["_b", "_place"]).where(near).select("a_c", "b_c").distinct())
    some = only(texts.select("_c", "runs"), pairs.select(F.col("a_c").alias("_c")).union(pairs.select("b_c")).distinct(), "_c")
    both = pairs.join(some.select(F.col("_c").alias("a_c"), F.col("runs").alias("_ra")), "a_c").join(some.select(F.col("_c").alias("b_c"), F.col("runs").alias("_rb")), "b_c")
    common = F.size(F.array_intersect("_ra", "_rb"))
    linked = stored(both.where(common >= F.lit(similarity - 1e-9) * (F.size("_ra") + F.size("_rb") - common)).select("a_c", "b_c"))
    links = linked.select(F.col("a_c").alias("_c")).union(linked.select("b_c")).groupBy("_c").agg(F.count("*").alias("links"))
    # clusters are named by their smallest key, so components run over those
    ends = linked.join(members.select(F.col("_c").alias("a_c"), F.col("_low").alias("a")), "a_c").join(members.select(F.col("_c").alias("b_c"), F.col("_low").alias("b")), "b_c").select("a", "b")
    found = components(ends)
    out = named.select("_k", "_c").join(members, "_c").join(links, "_c", "left").join(found.select(F.col("node").alias("_low"), "component"), "_low", "left")
    return out.select(F.col("_k").alias(key), F.coalesce("component", "_low").alias("cluster_id"), F.coalesce("links", F.lit(0)).alias("links"))
