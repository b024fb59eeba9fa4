import numpy as np

from textweft.llm import subjects


def test_sentences():
    text = "\\section{Head}\nOne two three. Four five\nsix seven! a b.\n\nNew part here; and more words"
    assert subjects.sentences(text) == [[["one", "two", "three"], ["four", "five", "six", "seven"]], [["new", "part", "here"], ["and", "more", "words"]]]
    assert subjects.sentences(None) == subjects.sentences(" \n ") == []


def test_latent_model_trusts_the_agreeing_function():
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 4, 4000)
    good = np.where(rng.random(4000) < 0.95, truth, rng.integers(0, 4, 4000))
    also = np.where(rng.random(4000) < 0.85, truth, 0)
    noise = rng.integers(0, 4, 4000)
    votes, n = np.unique(np.stack([also, good, noise], 1), axis=0, return_counts=True)
    post = subjects.latent_model(votes, n.astype(float), 3)
    best = {tuple(v): int(p.argmax()) for v, p in zip(votes, post, strict=True)}
    assert np.mean([best[tuple(v)] == t for v, t in zip(np.stack([also, good, noise], 1).tolist(), truth, strict=True)]) > 0.9


def corpus():
    words = {"law": ["court", "judge", "tort", "clause"], "sport": ["goal", "stride", "league", "coach"]}
    rng = np.random.default_rng(6)
    say = lambda s: f"The {rng.choice(words[s])} changes the {rng.choice(words[s])} in this matter."
    dull = lambda: "The remaining aspect is clean in every case."
    docs, labels = [], []
    for d in range(60):
        s = ["law", "sport"][d % 2]
        docs.append((d, " ".join([say(s) for _ in range(4)] + [dull() for _ in range(4)]), f"c{d % 7}", "s"))
        labels += [(d, s)] if d < 40 else []
    docs += [(100, " ".join([say("law")] * 3 + [say("sport")] * 3), None, None), (101, dull(), None, "s"), (102, None, "c", "s"), (103, " ", "c", "s"), (104, " ".join([say("law")] * 2 + [say("sport")]), "c", "s"), (105, say("sport"), "c", "s"), (106, " ".join([say("law")] + [dull()] * 5), "c", "s")]
    labels += [(101, None), (0, "law"), (999, "law")]
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, collection string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    names = spark.createDataFrame([("law",), ("sport",)], "subject string")
    out = subjects.document_subjects(d, lab, names)
    return d, names, out


def test_subjects_of_documents(spark):
    docs, labels = corpus()
    d, names, out = run(spark, docs, labels)
    got = {(r["doc_id"], r["subject"]) for r in out.collect()}
    want = {(i, ["law", "sport"][i % 2]) for i in range(60)} | {(100, "law"), (100, "sport"), (104, "law"), (105, "sport")}
    assert got == want
    parts = {r["subject"]: r["documents"] for r in subjects.composition(out, d, names).collect()}
    assert parts == {"law": 32, "sport": 32}


def test_without_labels_or_documents(spark):
    docs, labels = corpus()
    assert run(spark, docs, [])[2].count() == 0
    assert run(spark, [], labels)[2].count() == 0


def test_addresses_speak_only_beyond_chance(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "x", "court-docket" if i % 4 == 0 else f"c{i % 3}", None) for i in range(400)]
    labels = [(i, "law" if i % 4 == 0 and rng.random() < 0.9 else str(rng.choice(["law", "sport", "art", "food", "sea", "wood", "iron", "salt"]))) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string, collection string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    numbers = spark.createDataFrame([("art", 1), ("food", 2), ("law", 3), ("sport", 4)], "subject string, number int")
    assert [tuple(r) for r in subjects.column_votes(d, lab, "doc_id", "collection", numbers).collect()] == [("court-docket", 3)]
    assert subjects.column_votes(d, lab, "doc_id", "source", numbers).count() == 0


def test_headings_vote_for_their_section():
    text = "Start of it all.\n\\section{The tort} One thing is here. Another thing there.\n## A goal \nThe end of it."
    assert subjects.sections(text) == [("", "Start of it all.\n"), ("The tort", " One thing is here. Another thing there.\n"), ("A goal", "\nThe end of it.")]
    assert subjects.sections(None) == [] and subjects.sections("# only") == [("", ""), ("only", "")]
    votes = subjects.vote_patterns(text, {}, {"tort": 1, "goal": 2}, 0, 0, 3)
    # strict, broad, section, address, source: only the section has something to say
    assert votes == {0: 1, 1 * 9: 2, 2 * 9: 1}
