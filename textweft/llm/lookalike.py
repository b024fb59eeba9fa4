"""Problem 6: one form for texts that read the same.

Words that hold unusual characters are looked up in tries of the vocabulary's
plain words by a weighted edit automaton: look-alike letters and characters
that cannot be seen cost nothing, a letter's doubtful reading costs a part of
what a word may cost.  The cheapest match, then the most frequent, is the
canonical spelling.  Words without a match are written by the folding table.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint, group_arrow, map_arrow, only
from .common import require
from .glyphs import DOUBTFUL, FOLDING, fold, fold_character

END = ""
#: What reading a letter in its doubtful way costs, and the letters of a word for each such reading it may have.
DOUBT, LETTERS_A_DOUBT = 1.0, 3
#: Vocabulary words of one trie, about.
TRIE_WORDS = 50_000
#: Letters that doubtful readings make alike, for finding words that may match.
ALIKE = {ord("I"): "l"} | {ord(k): "l" if v == "I" else v for k, v in DOUBTFUL.items()}


def plain(word: str) -> bool:
    """Whether the word is already in the common form and has no second reading."""
    return word.isascii() or fold(word) == word and not mixed(word)


def mixed(word: str) -> bool:
    """Whether doubtful letters stand among Latin ones."""
    return any(c in DOUBTFUL for c in word) and any(c.isascii() and c.isalpha() for c in word)


@lru_cache(maxsize=100_000)
def in_word(c: str) -> bool:
    """Letters, their accents and characters that cannot be seen belong to words."""
    return c.isalpha() or unicodedata.combining(c) > 0 or c >= "\x80" and not fold_character(ord(c))


def segments(token: str) -> list[tuple[bool, str]]:
    """The token cut into words (true) and what stands between them."""
    if token.isalpha():
        return [(True, token)]
    return [(kind, "".join(part)) for kind, part in groupby(token, in_word)]


class Trie:
    """Vocabulary words by character, with the times each occurs."""

    def __init__(self, words):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[END] = node.get(END, 0) + n

    def search(self, word: str, budget: float | None = None) -> tuple[str, float] | None:
        """The vocabulary word nearest to ``word`` within ``budget``, then the most frequent, then the smallest.

        Reading a look-alike as the letter it looks like, a joined letter as its
        letters, a letter and its accents as one, or skipping a character that
        cannot be seen costs nothing; a doubtful reading costs DOUBT.  Any other
        change can be seen and is none.  Without ``budget`` a word may have one
        doubtful reading for every LETTERS_A_DOUBT of its letters.
        """
        units = readings(word)
        budget = len(units) // LETTERS_A_DOUBT * DOUBT if budget is None else budget
        best: tuple[float, int, str] | None = None
        # states: units read, the node reached, what was read, cost
        stack = [(0, self.root, "", 0.0)]
        while stack:
            i, node, read, cost = stack.pop()
            if i == len(units):
                if END in node and (best is None or (cost, -node[END], read) < best):
                    best = (cost, -node[END], read)
                continue
            for choice, price in units[i]:
                if cost + price > budget:
                    continue
                step = node
                for c in choice:
                    step = step.get(c)
                    if step is None:
                        break
                else:
                    stack.append((i + 1, step, read + choice, cost + price))
        return None if best is None else (best[2], best[0])


def readings(word: str) -> list[list[tuple[str, float]]]:
    """For each character with its accents: what it may be read as, and at what cost."""
    clusters: list[str] = []
    for c in unicodedata.normalize("NFD", word):
        if not fold_character(ord(c)) and ord(c) >= 0x80:
            continue
        if clusters and unicodedata.combining(c):
            clusters[-1] += c
        else:
            clusters.append(c)
    out = []
    for c in clusters:
        ways = {unicodedata.normalize("NFC", c.translate(FOLDING)): 0.0}
        ways.setdefault(unicodedata.normalize("NFC", c), 0.0)
        if c[0] in DOUBTFUL:
            ways.setdefault(unicodedata.normalize("NFC", DOUBTFUL[c[0]] + c[1:]), DOUBT)
        out.append(list(ways.items()))
    return out


def skeleton(word: str) -> str:
    """What all spellings that may match have in common."""
    return fold(word).translate(ALIKE)


def match_words(table):
    """Canonical spelling of every odd word of one trie."""
    import pyarrow as pa

    rows = list(zip(*(table.column(c).to_pylist() for c in ("word", "odd", "n")), strict=True))
    trie = Trie((w, n) for w, odd, n in rows if not odd)
    out = ([], [], [])
    for w in (w for w, odd, _ in rows if odd):
        hit = trie.search(w)
        for col, v in zip(out, (w, hit[0] if hit else fold(w), hit is not None), strict=True):
            col.append(v)
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_())], names=["word", "canonical", "matched"])


def canonical_words(rows: DataFrame, text: str, trie_words: int = TRIE_WORDS) -> DataFrame:
    """word, canonical, matched for every word of ``text`` that holds unusual characters.

    Distinct words are counted within each batch, then by one aggregation, so
    sizes follow the vocabulary and not the rows.  Of the plain words only those
    whose skeleton an odd word has are kept, which loses no match; they are dealt
    to tries of about ``trie_words`` by the skeleton's hash, so a common
    beginning or a vocabulary of any size makes no large trie.
    """

    def count(batches):
        import pyarrow as pa

        from textweft.llm.lookalike import plain as usual
        from textweft.llm.lookalike import segments as cut
        from textweft.llm.lookalike import skeleton as bare

        for batch in batches:
            tokens: Counter = Counter()
            for t in batch.column(0).to_pylist():
                tokens.update(t.split())
            n: Counter = Counter()
            for token, k in tokens.items():
                for word, part in cut(token):
                    if word:
                        n[part] += k
            words = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([bare(w) for w in words], pa.string()), pa.array(words, pa.string()), pa.array([not usual(w) for w in words], pa.bool_()), pa.array([n[w] for w in words], pa.int64())], names=["skeleton", "word", "odd", "n"])

    counted = map_arrow(rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")), count, "skeleton string, word string, odd boolean, n long")
    counted = checkpoint(counted.groupBy("skeleton", "word", "odd").agg(F.sum("n").alias("n")))
    wanted = checkpoint(only(counted, counted.where("odd").select("skeleton").distinct(), "skeleton"))
    tries = wanted.count() // trie_words + 1
    wanted = wanted.withColumn("_trie", F.pmod(F.xxhash64("skeleton"), F.lit(tries)))
    return group_arrow(wanted.groupBy("_trie"), wanted.select("word", "odd", "n", "_trie"), match_words, "word string, canonical string, matched boolean")


def one_form(rows: DataFrame, key: str = "row_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep``, text and canonical_text; texts that read the same get one canonical_text.

    Blanks of all kinds become single spaces, characters that cannot be seen
    go, and every word takes its canonical spelling.  Null texts stay null, blank
    ones become empty; repeated rows are kept.  Only rows that hold an odd word
    are shuffled, and only their odd words are joined.
    """
    require(rows, key, text, *keep)
    head = [key, *keep, text]
    schema = T.StructType([*[rows.schema[c] for c in head], *T.StructType.fromDDL("_words array<string>, _odd array<int>").fields])

    def cut(batches):
        import pyarrow as pa

        from textweft.llm.lookalike import pieces as cut_token

        known: dict = {}
        for batch in batches:
            words, odd = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                if t is None:
                    words.append(None)
                    odd.append(None)
                    continue
                parts = t.split()
                if t.isascii():
                    clean = " ".join(parts)
                    words.append([clean if clean.isprintable() else fold(clean)])
                    odd.append([])
                    continue
                row, at = [""], []
                for i, w in enumerate(parts):
                    if i:
                        row[-1] += " "
                    if w.isascii() and w.isprintable():
                        row[-1] += w
                        continue
                    found = known.get(w)
                    if found is None:
                        if len(known) > 500_000:
                            known.clear()
                        found = known[w] = cut_token(w)
                    for looked_up, piece in found:
                        if looked_up:
                            at.append(len(row))
                            row += [piece, ""]
                        else:
                            row[-1] += piece
                words.append(row)
                odd.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(odd, pa.list_(pa.int32()))], names=schema.names)

    parted = map_arrow(rows.select(*head), cut, schema)
    tidy = lambda c: F.trim(F.regexp_replace(c, " {2,}", " "))
    usual = parted.where("_odd IS NULL OR size(_odd) = 0").select(*head, tidy(F.element_at("_words", 1)).alias("canonical_text"))
    usual = usual.withColumn("canonical_text", F.when(F.col(text).isNotNull(), F.coalesce("canonical_text", F.lit(""))))
    # the key may repeat with another text, so the text's hash is part of it
    odd = checkpoint(parted.where("size(_odd) > 0").withColumn("_h", F.xxhash64(text)))
    found = checkpoint(canonical_words(rows, text))
    places = odd.select(key, "_h", "_words", F.explode("_odd").alias("_i")).select(key, "_h", "_i", F.expr("_words[_i]").alias("word")).distinct()
    spelled = places.join(found.select("word", "canonical"), "word").groupBy(key, "_h").agg(F.map_from_entries(F.collect_list(F.struct("_i", "canonical"))).alias("_new"))
    spelled = spelled.select(F.col(key).alias("_key2"), F.col("_h").alias("_h2"), "_new")
    same = F.col(key).eqNullSafe(F.col("_key2")) & (F.col("_h") == F.col("_h2"))
    mended = F.expr("array_join(transform(_words, (w, i) -> coalesce(element_at(_new, i), w)), '')")
    changed = odd.join(spelled, same, "left").select(*head, tidy(mended).alias("canonical_text"))
    return usual.unionByName(changed)


def pieces(token: str) -> list[tuple[bool, str]]:
    """A token's odd words (true), and what is between them in the common form."""
    return [(True, part) if word and not plain(part) else (False, part if word else between(part)) for word, part in segments(token)]


def between(part: str) -> str:
    """What stands between words, by the table; blanks are kept as spaces."""
    return part if part.isascii() and part.isprintable() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", part).translate(FOLDING))


def same_reading(canonical: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """Pairs of rows (smaller key first) that read the same but are stored differently."""
    rows = canonical.where("canonical_text <> ''").select(F.col(key).alias("k"), F.xxhash64("canonical_text").alias("c1"), F.hash("canonical_text").alias("c2"), F.xxhash64(text).alias("raw"))
    mixed = rows.groupBy("c1", "c2").agg(F.min("raw").alias("_a"), F.max("raw").alias("_b")).where("_a <> _b").select("c1", "c2")
    some = rows.join(mixed, ["c1", "c2"])
    other = some.select("c1", "c2", F.col("k").alias("k2"), F.col("raw").alias("raw2"))
    return some.join(other, ["c1", "c2"]).where("k < k2 AND raw <> raw2").select(F.col("k").alias(f"{key}_a"), F.col("k2").alias(f"{key}_b")).distinct()


def reading_classes(canonical: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """One row for each row: the smallest key that reads the same, and how many spellings there are."""
    rows = canonical.where("canonical_text <> ''").select(key, F.xxhash64("canonical_text").alias("_c1"), F.hash("canonical_text").alias("_c2"), F.xxhash64(text).alias("_raw"))
    classes = rows.groupBy("_c1", "_c2", "_raw").agg(F.min(key).alias("_low"), F.count("*").alias("_n")).groupBy("_c1", "_c2").agg(F.min("_low").alias("class_id"), F.count("*").alias("spellings"), F.sum("_n").alias("rows"))
    return rows.join(classes, ["_c1", "_c2"]).select(key, "class_id", "spellings", F.col("rows"))
