import random
from collections import Counter

import numpy as np

from chronoframe.llm.entries import QUERIES
from chronoframe.llm.toxicity import BIAS, DEFAULTS, INSULTS, PATTERNS, REACH, Matcher, _labelled, drop_toxic, score_toxicity, train

LEXICON = [w + "$" for w in INSULTS] + ["krumm"]


def matched(text):
    return {p: n for p, n in zip(PATTERNS, Matcher(LEXICON).counts(text)) if n}


def test_grammar():
    assert matched("You are an IDIOT, a moron.") == {("I", 0, 0, 1): 2}
    assert matched("This is not an idiot") == {("I", 1, 0, 0): 1}
    assert matched("Not one word of this. An idiot") == {("I", 0, 0, 0): 1}
    assert matched("She said they are stupid") == {("I", 0, 1, 1): 1}
    assert matched("krummlich and krummer; skrumm idiotic") == {("I", 0, 0, 0): 2}
    assert matched("I will kill you!!") == {("W", 0, 0, 2): 1}
    assert matched("I kill time, you idiot") == {("H", 0, 0, 2): 1, ("I", 0, 0, 1): 1}
    assert matched("an idiot for you") == {("I", 0, 0, 2): 1}
    assert matched("") == {} and matched("idiot") == {("I", 0, 0, 0): 1}
    assert sum(matched("idiot " * 5000).values()) == 5000


def naive(symbols):
    """The paths of a clause by their definitions, each match for itself."""
    found = Counter()
    for i, x in enumerate(symbols):
        if x not in "IH":
            continue
        before = symbols[:i]
        kind = "I" if x == "I" else "W" if "W" in before[-REACH:] else "H"
        aim = 1 if "T" in before else 2 if "T" in symbols[i:] else 0
        found[kind, int("N" in before[-REACH:]), int("R" in before), aim] += 1
    return dict(found)


def test_against_naive_grammar():
    rng = random.Random(6)
    word = {"I": "idiot", "H": "kill", "T": "you", "N": "not", "R": "said", "W": "will", "O": "house"}
    for _ in range(400):
        clauses = [rng.choices("IHTNRWO", [1, 1, 1, 1, 0.5, 1, 6], k=rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        text = rng.choice([". ", "; ", "\n", "!"]).join(" ".join(word[x] for x in c) for c in clauses)
        want = Counter()
        for c in clauses:
            want.update(naive("".join(c)))
        assert matched(text) == dict(want), text


def test_clauses_are_read_whole():
    far = " word" * 30_000
    assert matched(f"you{far} idiot") == {("I", 0, 0, 1): 1}
    assert matched(f"She said{far} moron{far} he") == {("I", 0, 1, 1): 1}
    assert matched(f"it is said{far} moron{far} you") == {("I", 0, 1, 2): 1}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5.0), (2, None, 5.0), (3, "", 5.0), (4, "fine words", 5.0)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon, weights = train(docs, labels)
    assert np.allclose(weights, [BIAS, *DEFAULTS])
    got = {r.doc_id: r.toxicity for r in score_toxicity(docs, lexicon, weights).collect()}
    assert got[1] > 0.7 > 0.1 > got[2] == got[3] == got[4]
    assert sorted(map(tuple, drop_toxic(docs, lexicon, weights).collect())) == [(2, None, 5.0), (3, "", 5.0), (4, "fine words", 5.0)]
    assert score_toxicity(docs.limit(0), lexicon, weights).collect() == []


def test_repeated_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you moron"), (1, None), (None, "you idiot"), (2, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (2, 7), (3, 1)], "doc_id long, toxic int")
    rows = _labelled(docs, labels, 100)
    assert sorted(map(tuple, rows.collect())) == [("fine words", 0), ("you moron", 0), ("you moron", 1)]
    assert _labelled(docs, labels, 1).count() == 1
    assert score_toxicity(docs, *train(docs, labels)).count() == 5


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"  # its labels hold some noise
    rows = QUERIES["op1_toxicity"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    caught = sum(r.predicted and r.toxic for r in rows)
    assert caught >= 0.85 * sum(r.toxic for r in rows) and caught >= 0.9 * sum(r.predicted for r in rows)
