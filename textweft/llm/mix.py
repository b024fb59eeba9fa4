"""Problem 8: mixing sources to target weights.

Texts are aggregated by the set of sources they stand in; a min-cost flow
routes their tokens to the sources' quotas, each further pass over a text
costing more than the last; documents are then selected by a seeded order.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, map_arrow
from .common import bounded_collect, require, take_by_threshold, unit_interval

#: How a text is divided before merging (the pattern published with the ranks).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Membership patterns (sets of sources) and sources that may come to the driver.
MAX_PATTERNS = 20_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(rows: DataFrame, keep: list[str], ranks: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """``keep`` columns and the token count of the whole ``text``; null and empty texts have 0.

    ranks: the tokenizer's file of merge ranks, at the same place on every machine.
    """
    schema = rows.select(*keep).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        import pyarrow as pa

        from textweft.llm.mix import tokenizer as load

        encode = load(ranks).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return map_arrow(rows.select(*keep, F.col(text).alias("_text")), run, schema)


class Flow:
    """Min-cost flow by successive shortest paths with potentials; integer capacities."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def used(self, k: int) -> int:
        return self.left[k ^ 1]

    def run(self, source: int, sink: int) -> int:
        n, sent = len(self.arcs), 0
        high = [0] * n
        while True:
            far, via = [None] * n, [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > far[v]:
                    continue
                for k in self.arcs[v]:
                    if self.left[k] > 0:
                        w = self.to[k]
                        e = d + self.cost[k] + high[v] - high[w]
                        if far[w] is None or e < far[w]:
                            far[w], via[w] = e, k
                            heapq.heappush(heap, (e, w))
            if far[sink] is None:
                return sent
            for v in range(n):
                if far[v] is not None:
                    high[v] += far[v]
            step, v = None, sink
            while v != source:
                k = via[v]
                step = self.left[k] if step is None else min(step, self.left[k])
                v = self.to[k ^ 1]
            v = sink
            while v != source:
                self.left[via[v]] -= step
                self.left[via[v] ^ 1] += step
                v = self.to[via[v] ^ 1]
            sent += step


def route(members: dict[tuple[str, ...], tuple[int, dict[str, int]]], wanted: dict[str, float], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens each membership pattern gives to each of its sources.

    members: pattern -> (tokens of its distinct texts, tokens of its documents
    by source).  A source takes at most repeats x its own tokens of a pattern.
    The r-th pass over a pattern's distinct texts costs r squared a token, from
    the third on by doublings (3 and 4 cost as 4, 5 to 8 as 8), so that any
    number of passes takes few arcs and each still costs more than those before.
    """
    names, patterns = sorted(wanted), sorted(members)
    flow = Flow(2 + len(names) + 2 * len(patterns))
    at = {s: 2 + i for i, s in enumerate(names)}
    for s in names:
        flow.arc(at[s], 1, int(-(-wanted[s] // 1)), 0)
    arcs = {}
    for i, p in enumerate(patterns):
        once, own = members[p]
        node = 2 + len(names) + 2 * i
        rest = sum(repeats[s] * own[s] for s in p)
        done, upto = 0, 1
        while rest > 0 and once > 0:
            step = min(rest, (upto - done) * once)
            flow.arc(0, node, step, upto * upto)
            rest, done, upto = rest - step, upto, 2 * upto
        for s in p:
            if own[s] > 0 and repeats[s] > 0:
                arcs[p, s] = flow.arc(node, at[s], repeats[s] * own[s], 0)
    flow.run(0, 1)
    return {k: flow.used(a) for k, a in arcs.items()}


@dataclass
class Mix:
    rows: DataFrame
    report: DataFrame


def mix_sources(documents: DataFrame, targets: DataFrame, ranks: str, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 11) -> Mix:
    """Select documents, with repeats, so that each source has its share of all tokens.

    targets: source, target_share, max_repeats.  The mix is as large as the
    documents of the target sources together.  rows: key, source, tokens,
    repeats (1..max_repeats).  report: per source its share, own tokens, wanted,
    routed and selected tokens, the share reached and ``short`` where the flow,
    which repeats all its documents as often as allowed, stays below the wanted
    tokens.

    Equal texts under several sources form one membership pattern, so repeats
    go first to texts used least.  Null sources and sources without a target are left out;
    null and empty texts have no tokens and are not selected.  Repeated rows are
    separate rows.  Empty tables give
    an empty mix.  Only sums by (pattern, source) come to the driver.
    """
    require(documents, key, source, text)
    spark = documents.sparkSession
    want = {r["source"]: r for r in bounded_collect(targets.where("source IS NOT NULL"), MAX_PATTERNS, "source targets")}
    names = targets.select(F.col("source").alias("_s")).where("_s IS NOT NULL").distinct()
    own_rows = documents.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(text).alias("_x")).join(names, "_s", "left_semi")
    hashed = own_rows.select("_k", "_s", F.xxhash64("_x").alias("_h1"), F.hash("_x").alias("_h2"), "_x")
    # the row number tells repeated keys apart; it is fixed by being written down
    counted = checkpoint(with_tokens(hashed, ["_k", "_s", "_h1", "_h2"], ranks, "_x").withColumn("_i", F.monotonically_increasing_id()))

    texts = counted.where("tokens > 0").groupBy("_h1", "_h2", "_s").agg(F.sum("tokens").alias("_own"), F.max("tokens").alias("_once"))
    # at most one row a source for each text, whatever the number of copies
    grouped = texts.groupBy("_h1", "_h2").agg(F.sort_array(F.collect_set("_s")).alias("_p"), F.max("_once").alias("_once"))
    once = grouped.groupBy("_p").agg(F.sum("_once").alias("_once"))
    by_pattern = texts.drop("_once").join(grouped.drop("_once"), ["_h1", "_h2"]).groupBy("_p", "_s").agg(F.sum("_own").alias("_own"))
    members: dict = {}
    for r in bounded_collect(by_pattern.join(once, "_p"), MAX_PATTERNS * 4, "membership patterns"):
        p = tuple(r["_p"])
        members.setdefault(p, (int(r["_once"]), dict.fromkeys(p, 0)))[1][r["_s"]] = int(r["_own"])
    own = dict.fromkeys(want, 0)
    for _, by in members.values():
        for s, n in by.items():
            own[s] += n
    total = sum(own.values())
    wanted = {s: float(r["target_share"] or 0) * total for s, r in want.items()}
    repeats = {s: int(r["max_repeats"] or 0) for s, r in want.items()}
    routed = route(members, wanted, repeats)

    parts = [("|".join(p), list(p), s, n // members[p][1][s], n % members[p][1][s]) for (p, s), n in routed.items() if members[p][1][s]]
    plan = spark.createDataFrame([(p, s, int(q), int(rest)) for _, p, s, q, rest in parts], "_p array<string>, _s string, _full long, _rest_tokens long")
    rows = (
        counted.where("tokens > 0")
        .join(grouped.select("_h1", "_h2", "_p"), ["_h1", "_h2"])
        .join(plan, ["_p", "_s"])
        .withColumn("_rank", unit_interval(F.col("_k"), F.lit(seed)))
    )
    more = take_by_threshold(rows.where("_rest_tokens > 0"), ["_p", "_s"], "_rank", "_i", "tokens", plan, "_rest_tokens").select("_i", "_k", "_s", "tokens", F.lit(1).alias("_n"))
    full = rows.where("_full > 0").select("_i", "_k", "_s", "tokens", F.col("_full").alias("_n"))
    chosen = full.unionByName(more).groupBy("_i", "_k", "_s", "tokens").agg(F.sum("_n").alias("repeats"))
    chosen = chosen.select(F.col("_k").alias(key), F.col("_s").alias(source), "tokens", "repeats")

    sums: dict = dict.fromkeys(want, 0)
    for (_, s), n in routed.items():
        sums[s] += n
    base = spark.createDataFrame(
        [(s, float(want[s]["target_share"] or 0), repeats[s], own[s], wanted[s], sums[s], sums[s] < wanted[s]) for s in sorted(want)],
        "source string, target_share double, max_repeats int, own_tokens long, wanted_tokens double, routed_tokens long, short boolean",
    )
    got = chosen.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("selected_tokens"))
    report = base.join(got, "source", "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)))
    from pyspark.sql import Window as W

    report = report.withColumn("reached_share", F.col("selected_tokens") / F.greatest(F.lit(1), F.sum("selected_tokens").over(W.partitionBy())))
    return Mix(chosen, report)
