"""Problem 9: the subjects of each document.

Labelling functions (two lexicons, the section a sentence stands in, the
document's address and source) vote on every sentence; a latent model learns
how far each can be trusted from how the votes agree; sentences take the
subject with the highest posterior and documents the subjects of enough of
their sentences.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import attach, checkpoint, map_arrow
from .common import bounded_collect, require
from .glyphs import fold

#: Labelled documents the lexicon is fitted on, taken in hash order.
MAX_LABELLED = 20_000
#: Words a lexicon may have; vote patterns that may occur (LFs x subjects bound them).
MAX_LEXICON = 500_000
MAX_PATTERNS = 2_000_000

FUNCTIONS = ("strict lexicon", "broad lexicon", "section", "address", "source")
UNSEEN = re.compile(r"\\[a-zA-Z]+\*?\{[^{}]*\}")
HEADING = re.compile(r"\\(?:part|chapter|(?:sub)*section|paragraph|title)\*?\{([^{}]*)\}|^[ \t]*#+[ \t]+(.+)$", re.MULTILINE)
PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def sentences(text: str | None, shortest: int = 3) -> list[list[list[str]]]:
    """Paragraphs of sentences of words; headings, citations and scraps under ``shortest`` words are left out."""
    if not text:
        return []
    out = []
    if "\\" in text:
        text = UNSEEN.sub("\n\n", text)
    for part in PARAGRAPH.split(text):
        found = [w for w in map(WORD.findall, SENTENCE.split(fold(part).lower())) if len(w) >= shortest]
        if found:
            out.append(found)
    return out


def majority(votes: list[int]) -> int:
    """The value seen most often; 0 if there is none or no single one."""
    if not votes:
        return 0
    if votes.count(votes[0]) == len(votes):
        return votes[0]
    first, *rest = Counter(votes).most_common(2)
    return first[0] if not rest or rest[0][1] < first[1] else 0


def sections(text: str | None) -> list[tuple[str, str]]:
    """Heading ("" before the first) and text of each section."""
    if not text:
        return []
    if "\\" not in text and "#" not in text:
        return [("", text)]
    out, heading, start = [], "", 0
    for m in HEADING.finditer(text):
        out.append((heading, text[start : m.start()]))
        heading, start = (m.group(1) or m.group(2) or "").strip(), m.end()
    return [*out, (heading, text[start:])]


def vote_patterns(text: str | None, strict: dict, broad: dict, address: int, source: int, base: int) -> Counter:
    """How often each combination of the functions' votes occurs among a document's sentences.

    The section votes by the known words of its heading; where the heading has
    none, by the sentences around.
    """
    out: Counter = Counter()
    for heading, body in sections(text):
        above = majority([broad[w] for w in WORD.findall(heading.lower()) if w in broad]) if heading else 0
        for part in sentences(body):
            near = []
            for words in part:
                known = [broad[w] for w in words if w in broad]
                near.append((majority([strict[w] for w in words if w in strict]) if known else 0, majority(known)))
            for i, (a, b) in enumerate(near):
                around = above or majority([v for _, v in near[max(0, i - 2) : i] + near[i + 1 : i + 3] if v])
                out[(((a * base + b) * base + around) * base + address) * base + source] += 1
    return out


def lexicon(documents: DataFrame, labels: DataFrame, key: str, text: str, most: int = MAX_LABELLED) -> DataFrame:
    """word, subject, docs (labelled documents with the word), purity (the part of them with that subject).

    From documents with exactly one distinct label, null ("no subject") counting as a label.
    """
    one = labels.where(F.col(key).isNotNull()).select(key, F.coalesce("subject", F.lit("")).alias("_s")).groupBy(key).agg(F.min("_s").alias("_s"), F.max("_s").alias("_t")).where("_s = _t")
    one = one.select(key, "_s").orderBy(F.xxhash64(key), key).limit(most)
    rows = documents.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).join(one, key).select("_s", "_text")

    def run(batches):
        import pyarrow as pa

        from textweft.llm.subjects import sentences as cut

        n: Counter = Counter()
        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n.update((w, s) for w in {w for part in cut(t) for words in part for w in words})
        pairs = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([s for _, s in pairs], pa.string()), pa.array([n[p] for p in pairs], pa.int64())], names=["word", "subject", "n"])

    counts = map_arrow(rows, run, "word string, subject string, n long").groupBy("word", "subject").agg(F.sum("n").alias("n"))
    best = counts.groupBy("word").agg(F.sum("n").alias("docs"), F.max_by("subject", F.struct("n", "subject")).alias("subject"), F.max("n").alias("_n"))
    return best.where("subject <> ''").select("word", "subject", "docs", (F.col("_n") / F.col("docs")).alias("purity"))


def column_votes(documents: DataFrame, labels: DataFrame, key: str, column: str, numbers: DataFrame, least: int = 5, share: float = 0.3, lift: float = 2.0) -> DataFrame:
    """value, vote: the subject's number for values of ``column`` that speak for one.

    A value does if it has ``least`` labels, ``share`` of them of one subject,
    and these less two standard deviations are still ``lift`` times what chance
    gives.  How far such a vote can be trusted is for the latent model to learn.
    numbers: subject, number.
    """
    said = labels.select(key, F.coalesce("subject", F.lit("")).alias("subject")).distinct()
    n = documents.where(F.col(column).isNotNull()).select(key, F.col(column).cast("string").alias("value")).join(said, key).groupBy("value", "subject").agg(F.count("*").alias("n"))
    best = n.groupBy("value").agg(F.sum("n").alias("labels"), F.max_by("subject", F.struct("n", "subject")).alias("subject"), F.max("n").alias("n"))
    usual = said.groupBy("subject").agg(F.count("*").alias("all"))
    usual = usual.withColumn("total", F.sum("all").over(Window.partitionBy()))
    chosen = best.join(F.broadcast(usual), "subject").where((F.col("labels") >= least) & (F.col("n") >= share * F.col("labels")) & ((F.col("n") - 2 * F.sqrt("n")) * F.col("total") >= lift * F.col("labels") * F.col("all")))
    return chosen.join(F.broadcast(numbers), "subject").select("value", F.col("number").alias("vote"))


def latent_model(votes: np.ndarray, weight: np.ndarray, k: int, rounds: int = 60) -> np.ndarray:
    """Posterior of each pattern over 0 (no subject) and the ``k`` subjects.

    votes: patterns x functions, 0 for an abstention.  Every function has, for
    sentences with a subject, a chance to abstain, to be right and to be wrong
    (evenly among the others), and, for those without, a chance to abstain or to
    name any; these and the class shares are fitted by expectation maximisation.
    """
    n, m = votes.shape
    post = np.full((n, k + 1), 0.02 / (k + 1))
    start = np.where(votes[:, 1] > 0, votes[:, 1], votes[:, 0])
    post[np.arange(n), start] += 0.98
    classes = np.arange(1, k + 1)
    for _ in range(rounds):
        mass = post * weight[:, None]
        share = (mass.sum(0) + 1) / (mass.sum() + k + 1)
        log = np.tile(np.log(share), (n, 1))
        for j in range(m):
            v = votes[:, j]
            silent = v == 0
            some = mass[:, 1:].sum()
            mute = (mass[silent, 1:].sum() + 1) / (some + 3)
            right = (mass[np.arange(n)[~silent], v[~silent]].sum() + 1) / (some + 3)
            wrong = max(1e-9, 1 - mute - right) / max(1, k - 1)
            none = (mass[silent, 0].sum() + 1) / (mass[:, 0].sum() + 2)
            log[:, 0] += np.where(silent, np.log(none), np.log((1 - none) / k))
            log[:, 1:] += np.where(silent[:, None], np.log(mute), np.where(v[:, None] == classes[None, :], np.log(right), np.log(wrong)))
        log -= log.max(1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max(initial=0) < 1e-6
        post = new
        if done:
            break
    return post


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", address: str = "collection", source: str = "source", share: float = 0.25) -> DataFrame:
    """key, subject, sentences (of the document), about (of them on the subject).

    A document has a subject if at least ``share`` of its sentences are about
    it, each by the posterior that passes a half; one single sentence does not
    count beside another subject with more.
    Null and blank documents and those about nothing have no row; repeated rows
    give one row each time the key is new.  Without labels nothing is assigned.

    Only the lexicon and the vote patterns come to the driver, each with a
    checked bound; what addresses and sources speak for is joined.  Every
    sentence of every document votes.
    """
    require(documents, key, text, address, source)
    names = sorted(r["subject"] for r in bounded_collect(subjects.where("subject IS NOT NULL").select("subject").distinct(), 1000, "subjects"))
    at = {s: i + 1 for i, s in enumerate(names)}
    base = len(names) + 1
    words = bounded_collect(lexicon(documents, labels, key, text).where("docs >= 2 AND purity >= 0.6"), MAX_LEXICON, "lexicon")
    broad = {r["word"]: at[r["subject"]] for r in words if r["subject"] in at}
    strict = {r["word"]: at[r["subject"]] for r in words if r["subject"] in at and r["purity"] >= 0.9 and r["docs"] >= 3}
    numbers = documents.sparkSession.createDataFrame(list(at.items()), "subject string, number int")

    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), *T.StructType.fromDDL("sentences int, patterns array<bigint>, times array<int>").fields])
    rows = documents.where(F.col(text).isNotNull()).select(key, F.col(address).cast("string").alias("_a"), F.col(source).cast("string").alias("_s"), F.col(text).alias("_text"))
    for short, column in (("_a", address), ("_s", source)):
        votes = column_votes(documents, labels, key, column, numbers)
        rows = attach(rows, votes.select(F.col("value").alias(short), F.col("vote").alias(short + "v")), short, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select(key, zero("_av").alias("_av"), zero("_sv").alias("_sv"), "_text")

    def run(batches):
        import pyarrow as pa

        from textweft.llm.subjects import vote_patterns as vote

        for batch in batches:
            _, a, s, t = (c.to_pylist() if i else c for i, c in enumerate(batch.columns))
            found = [vote(x, strict, broad, p, q, base) for x, p, q in zip(t, a, s, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sum(c.values()) for c in found], pa.int32()), pa.array([list(c) for c in found], pa.list_(pa.int64())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                names=[key, "sentences", "patterns", "times"],
            )

    voted = checkpoint(map_arrow(rows, run, schema).where("sentences > 0"))
    seen = voted.select(F.explode(F.arrays_zip("patterns", "times")).alias("_z")).groupBy(F.col("_z.patterns").alias("pattern")).agg(F.sum("_z.times").alias("n"))
    patterns = bounded_collect(seen, MAX_PATTERNS, "vote patterns")
    codes = np.array([r["pattern"] for r in patterns], dtype=np.int64)
    weight = np.array([r["n"] for r in patterns], dtype=float)
    votes = np.stack([codes // base**j % base for j in reversed(range(len(FUNCTIONS)))], 1) if len(codes) else np.zeros((0, len(FUNCTIONS)), np.int64)
    post = latent_model(votes, weight, len(names)) if len(codes) else np.zeros((0, base))
    best = {int(c): int(p.argmax()) for c, p in zip(codes, post, strict=True) if p.max() > 0.5 and p.argmax()}

    out = T.StructType([T.StructField(key, documents.schema[key].dataType), *T.StructType.fromDDL("subject string, sentences int, about int").fields])

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            take, cols = [], ([], [], [])
            for i, (total, codes, times) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
                n: Counter = Counter()
                for c, k in zip(codes, times, strict=True):
                    if c in best:
                        n[best[c]] += k
                top = max(n.values(), default=0)
                for s, k in n.items():
                    if k >= share * total and not (k == 1 and top > 1):
                        take.append(i)
                        for col, v in zip(cols, (names[s - 1], total, k), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=out.names)

    return map_arrow(voted, assign, out)


def composition(assigned: DataFrame, documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per subject: documents about it and their part of all documents."""
    total = max(1, documents.count())
    n = assigned.groupBy("subject").agg(F.count("*").alias("documents"))
    return subjects.select("subject").join(n, "subject", "left").withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("share", F.col("documents") / F.lit(total))
