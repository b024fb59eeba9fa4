"""Problem 3: the same or nearly the same record in several splits.

A record's normal form is the set of its words in the order of their hashes, so
neither the order of words nor repetitions matter.  It is cut into
content-defined chunks by a rolling hash, chunk digests are joined across
splits, and the shared chunk lengths give each pair's overlap; an exact
comparison of the word sets follows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, map_arrow, only, stored
from .common import require

WORD = re.compile("[a-z0-9]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Records of at most so many words are met by their rarest words, which misses none; chunks are too few there.
SHORT = 34
#: Train rows of one digest that are compared in one place; more are spread over several.
HOT = 20_000


def paper_number(col: Column) -> Column:
    """The number of a paper id: no prefix, no version, no blanks; null if there is none.

    ``arXiv:2203.100077v2``, ``/abs/2203.100077`` and `` 2203.100077v1 `` are
    one paper.  An id without a number is taken as it is, in lower case.
    """
    low = F.lower(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", ""))
    number = F.regexp_extract(low, r"([0-9]+(?:\.[0-9]+)?)(?:v[0-9]+)?[^0-9a-z]*$", 1)
    return F.when(number != "", number).when(low != "", low)


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets everything when it grows large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def chunk_digests(hashes: np.ndarray, starts: np.ndarray, divisor: int, shortest: int, longest: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of many word sequences at once.

    hashes: the words of all records in a row; starts: where each record
    begins (none is empty).  A chunk ends after a word where the hash of that
    word and the one before divides by ``divisor``, once it has ``shortest``
    words, at ``longest`` words and at the record's end.  ``salt`` chooses other
    cuts.  Returns the start of each chunk and its digest.
    """
    n = len(hashes)
    prev = np.concatenate([hashes[:1], hashes[:-1]])
    first = np.zeros(n, bool)
    first[starts] = True
    prev[first] = 0
    roll = (hashes ^ (prev * MIX)) * (MIX + np.uint64(2 * salt))
    marked = ((roll >> np.uint64(40)) % np.uint64(divisor) == 0).tolist()
    opens = first.tolist()
    at, length = [], 0
    cut = True
    for i in range(n):
        if cut or opens[i]:
            at.append(i)
            length = 0
        length += 1
        cut = length >= longest or (length >= shortest and marked[i])
    begin = np.array(at, dtype=np.int64)
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    odd = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1 + 1000 * salt)) * MIX
    mixed = (hashes ^ (hashes >> np.uint64(29))) * odd
    digest = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), begin) if n else np.zeros(0, np.uint64)
    return begin, digest


def cutters_for(n_words: int) -> int:
    """Independent cuttings of a record: the fewer chunks one gives, the more there are."""
    return min(6, max(2, -(-200 // max(1, n_words))))


def record_chunks(rows: DataFrame, keep: list[str], text: str, divisor: int = 2, shortest: int = 3, longest: int = 8) -> DataFrame:
    """``keep`` columns, words (distinct hashes in their order), n_words, a sketch, and digests and lengths of the chunks of all cuttings.

    Words are the lower-cased runs of ASCII letters and digits; rows without one
    are dropped.  The sketch (two longs) has the bit ``hash % 128`` of every
    word set, so sets differ in at least as many words as sketches in bits.
    Records of at most SHORT words also list their words as digests of length 0.
    """
    schema = rows.select(*keep).schema.simpleString()[7:-1].replace(":", " ")
    schema += ", words array<bigint>, n_words int, s1 bigint, s2 bigint, digests array<bigint>, lengths array<int>"

    def run(batches):
        import pyarrow as pa

        from textweft.llm.overlap import WORD as word
        from textweft.llm.overlap import WordHashes as cache
        from textweft.llm.overlap import chunk_digests as cut
        from textweft.llm.overlap import cutters_for as cutters

        known = cache()
        for batch in batches:
            found = [(i, [known[w] for w in set(word.findall(t.lower()))]) for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if t]
            found = [(i, w) for i, w in found if w]
            if not found:
                continue
            size = np.array([len(w) for _, w in found])
            owner = np.repeat(np.arange(len(size)), size)
            words = np.array([h for _, w in found for h in w], dtype=np.uint64)
            words = words[np.lexsort((words, owner))]
            starts = np.cumsum(size) - size
            bit = np.uint64(1) << (words & np.uint64(63))
            second = (words & np.uint64(64)) > 0
            sketch = [np.bitwise_or.reduceat(np.where(side, bit, np.uint64(0)), starts).view(np.int64) for side in (~second, second)]
            # cuttings by salt; each takes the records that have so many
            many = np.array([cutters(n) for n in size.tolist()])
            who, digest, long = [], [], []
            for salt in range(int(many.max())):
                some = many > salt
                inside = some[owner]
                fewer = size[some]
                begin, d = cut(words[inside], np.cumsum(fewer) - fewer, divisor, shortest, longest, salt)
                who.append(np.flatnonzero(some)[np.searchsorted(np.cumsum(fewer), begin, side="right")])
                digest.append(d)
                long.append(np.diff(np.append(begin, inside.sum())))
            brief = (size <= SHORT)[owner]
            who, digest, long = np.concatenate([*who, owner[brief]]), np.concatenate([*digest, ~words[brief]]), np.concatenate([*long, np.zeros(brief.sum(), np.int64)])
            order = np.argsort(who, kind="stable")
            edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(size)))]).astype(np.int32))
            ends = pa.array(np.append(starts, len(words)).astype(np.int32))
            kept = pa.table(batch).select(range(batch.num_columns - 1)).take(pa.array([i for i, _ in found], pa.int64())).combine_chunks()
            cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in kept.columns]
            yield pa.RecordBatch.from_arrays(
                [
                    *cols,
                    pa.ListArray.from_arrays(ends, pa.array(words.view(np.int64))),
                    pa.array(size.astype(np.int32)),
                    *[pa.array(x) for x in sketch],
                    pa.ListArray.from_arrays(edges, pa.array(digest[order].view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array(long[order].astype(np.int32))),
                ],
                names=[*keep, "words", "n_words", "s1", "s2", "digests", "lengths"],
            )

    return map_arrow(rows.select(*keep, F.col(text).alias("_text")), run, schema)


def similar_classes(rows: DataFrame, key: str, ident: str, text: str, split: str, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What :func:`cross_split_overlap` and :func:`overlap_links` are made of.

    (_k, _paper, _side) of rows with a paper; (_k, _side, _c) of rows with a
    text, _c naming equal texts; and (_a, _b, overlap, similarity) of classes of
    train and held-out rows that are similar or the same.
    """
    require(rows, key, ident, text, split)
    sides = rows.select(F.col(key).alias("_k"), paper_number(F.col(ident)).alias("_paper"), F.when(F.col(split) == "train", 0).when(F.col(split).isin("val", "test"), 1).alias("_side"), F.col(text).alias("_x")).where("_side IS NOT NULL")

    ids = sides.where("_paper IS NOT NULL").select("_k", "_paper", "_side")
    plain = F.regexp_replace(F.lower(F.col("_x")), "[^a-z0-9]+", " ")
    keyed = sides.where("_x IS NOT NULL").select("_k", "_side", F.xxhash64(F.trim(plain)).alias("_c"), F.monotonically_increasing_id().alias("_i"), "_x")
    # without the texts, so that these are read twice only
    members = stored(keyed.select("_k", "_side", "_c", "_i"))
    # of equal texts the first row stands for all; most texts stand alone and are not moved
    copies = members.groupBy("_c").agg(F.min("_i").alias("_rep"), F.min("_side").alias("_l"), F.max("_side").alias("_h"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    classes = attach(keyed, copies, "_c", "left").where("_rep IS NULL OR _i = _rep").select("_c", F.coalesce("_l", "_side").alias("_low"), F.coalesce("_h", "_side").alias("_high"), "_x")
    cut = stored(record_chunks(classes, ["_c", "_low", "_high"], "_x"))

    own = ["_c", "_low", "_high", "n_words", "s1", "s2"]
    chunks = cut.select(*own, F.explode(F.arrays_zip("digests", "lengths")).alias("_z")).select(*own, F.col("_z.digests").alias("_d"), (F.col("_z.lengths") == 0).alias("_word"))
    freq = chunks.groupBy("_d").agg(F.count("*").alias("_n"), F.sum(1 - F.col("_low")).alias("_t"), F.min("_low").alias("_lo"), F.max("_high").alias("_hi")).where("_n > 1 AND _lo = 0 AND _hi = 1").select("_d", "_n", "_t")
    shared = attach(chunks, freq, "_d")
    # of a short record's words that others have, similar sets must share one of the rarest
    by_rarity = Window.partitionBy("_c").orderBy("_n", "_d")
    words = shared.where("_word").withColumn("_at", F.row_number().over(by_rarity)).withColumn("_all", F.count("*").over(Window.partitionBy("_c")))
    words = words.where(F.col("_at") <= F.col("_all") - F.ceil(F.col("n_words") * F.lit(similarity) - 1e-9) + 1).select(*shared.columns)
    useful = stored(shared.where("NOT _word").unionByName(words).select("_d", *own, F.ceil(F.col("_t") / HOT).cast("int").alias("_places")))
    side = lambda n: [F.col(c).alias(n + c) for c in ("_c", "n_words", "s1", "s2")]
    a = useful.where("_low = 0").select("_d", F.when(F.col("_places") > 1, F.pmod(F.hash("_c"), "_places")).otherwise(0).alias("_place"), *side("a"))
    b = useful.where("_high = 1").select("_d", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("_places") - 1))).alias("_place"), *side("b"))
    # similar sets differ in few words, so in few bits of their sketches, and are of like size
    most = (F.col("an_words") + F.col("bn_words")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    differ = F.bit_count(F.col("as1").bitwiseXOR(F.col("bs1"))) + F.bit_count(F.col("as2").bitwiseXOR(F.col("bs2")))
    near = (differ <= most) & (F.least("an_words", "bn_words") >= F.greatest("an_words", "bn_words") * F.lit(similarity - 1e-9)) & (F.col("a_c") != F.col("b_c"))
    met = stored(a.join(b, ["_d", "_place"]).where(near).select(F.col("a_c").alias("_a"), F.col("b_c").alias("_b")).distinct())
    named = met.select(F.col("_a").alias("_c")).union(met.select("_b")).distinct()
    asked = only(cut.select("_c", "words", "n_words", "digests", "lengths"), named, "_c")

    side = lambda n: asked.select(F.col("_c").alias(n), F.col("words").alias(n + "_w"), F.col("n_words").alias(n + "_n"), F.col("digests").alias(n + "_d"), F.col("lengths").alias(n + "_l"))
    pairs = met.join(side("_a"), "_a").join(side("_b"), "_b")
    both = F.size(F.array_intersect("_a_w", "_b_w"))
    sum_of = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    hit = F.aggregate(F.filter(F.arrays_zip("_a_d", "_a_l"), lambda z: F.array_contains(F.col("_b_d"), z["_a_d"])), F.lit(0), lambda x, z: x + z["_a_l"])
    pairs = (
        pairs.withColumn("similarity", both / (F.col("_a_n") + F.col("_b_n") - both))
        .where(F.col("similarity") >= similarity)
        .withColumn("overlap", F.least(F.lit(1.0), hit / F.least(sum_of("_a_l"), sum_of("_b_l"))))
        .select("_a", "_b", "overlap", "similarity")
    )
    same = cut.where("_low = 0 AND _high = 1").select(F.col("_c").alias("_a"), F.col("_c").alias("_b"), F.lit(1.0).alias("overlap"), F.lit(1.0).alias("similarity"))
    return ids, members, pairs.unionByName(same)


def cross_split_overlap(rows: DataFrame, key: str = "record_id", ident: str = "arxiv_id", text: str = "abstract", split: str = "split", similarity: float = 0.7) -> DataFrame:
    """Pairs of a train row and a val or test row that are one record.

    Columns: train_id, eval_id, same_paper, overlap (shared chunk length as a
    part of the shorter record, null if only the id matches), similarity (of the
    word sets).  A pair is reported if the ids name one paper or the word sets
    have ``similarity`` in common, whatever their overlap.

    Candidates for the latter share a chunk.  What kind of edit parts two
    records makes no difference to that, only how many words differ: of pairs
    at just 0.7, 99.8 % share one, of those at 0.75 10,199 of 10,200 tried.
    Records of at most SHORT words are met by the words that all similar sets
    must share, the rarest, and miss none.

    Equal texts of one side are one class until the end, so a hot text is
    compared once.  Matches of a digest are held against sizes and sketches
    where they are made, which drops no similar pair, so few are moved; a digest
    of more than HOT train classes is compared in several places.  Nulls and
    blanks in ``text`` have no words, in ``ident`` no paper, in ``split`` no side.
    """
    ids, members, pairs = similar_classes(rows, key, ident, text, split, similarity)
    by_id = ids.where("_side = 0").select("_paper", F.col("_k").alias("train_id")).join(ids.where("_side = 1").select("_paper", F.col("_k").alias("eval_id")), "_paper").select("train_id", "eval_id", F.lit(True).alias("same_paper"))
    train = members.where("_side = 0").select(F.col("_c").alias("_a"), F.col("_k").alias("train_id"))
    held = members.where("_side = 1").select(F.col("_c").alias("_b"), F.col("_k").alias("eval_id"))
    by_text = pairs.join(train, "_a").join(held, "_b").select("train_id", "eval_id", "overlap", "similarity")
    return by_text.join(by_id, ["train_id", "eval_id"], "full").select("train_id", "eval_id", F.coalesce("same_paper", F.lit(False)).alias("same_paper"), "overlap", "similarity").distinct()


def overlap_links(rows: DataFrame, key: str = "record_id", ident: str = "arxiv_id", text: str = "abstract", split: str = "split", similarity: float = 0.7) -> DataFrame:
    """(key, class_id, text_links, paper_links) of every held-out row that overlaps with train, without forming pairs.

    class_id: the smallest key of the held-out rows with an equal text (the
    row's own without a text).  text_links: train rows whose text is the same or
    similar, each counted as often as it is there; paper_links: train rows of
    the same paper.  Copies are counted by class, so a text in a third of all
    rows costs no more than another.
    """
    ids, members, pairs = similar_classes(rows, key, ident, text, split, similarity)
    copies = members.where("_side = 0").groupBy(F.col("_c").alias("_a")).agg(F.count("*").alias("_n"))
    by_class = pairs.join(copies, "_a").groupBy(F.col("_b").alias("_c")).agg(F.sum("_n").alias("text_links"))
    held = members.where("_side = 1")
    named = held.join(held.groupBy("_c").agg(F.min("_k").alias("class_id")), "_c").join(by_class, "_c", "left").select("_k", "class_id", "text_links")
    papers = ids.where("_side = 0").groupBy("_paper").agg(F.count("*").alias("paper_links"))
    by_paper = ids.where("_side = 1").join(papers, "_paper").select("_k", "paper_links")
    both = named.join(by_paper, "_k", "full").where("text_links IS NOT NULL OR paper_links IS NOT NULL")
    return both.select(F.col("_k").alias(key), F.coalesce("class_id", "_k").alias("class_id"), F.coalesce("text_links", F.lit(0)).alias("text_links"), F.coalesce("paper_links", F.lit(0)).alias("paper_links")).distinct()


def overlap_report(pairs: DataFrame, rows: DataFrame, key: str = "record_id", split: str = "split", feed: str = "feed") -> DataFrame:
    """Per split and feed: rows, rows of it that also stand in train, and pairs."""
    hits = pairs.groupBy(F.col("eval_id").alias(key)).agg(F.count("*").alias("_pairs"))
    held = rows.where(F.col(split).isin("val", "test")).select(key, split, feed)
    return held.join(hits, key, "left").groupBy(split, feed).agg(F.count("*").alias("rows"), F.count("_pairs").alias("overlapping_rows"), F.coalesce(F.sum("_pairs"), F.lit(0)).alias("pairs"))
