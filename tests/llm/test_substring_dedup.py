import random

import numpy as np
import pytest

from chronoframe.llm.entries import ORACLES, QUERIES
from chronoframe.llm.substring_dedup import dedup_substrings, factors
from tests.oracle import assert_matches


def brute(rows, window):
    first = {}
    for doc_id, text in rows:
        w = (text or "").split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = (text or "").split()
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] for _ in range(12)]
    passages.append(["same"] * 120)
    passages.append(["a", "b", "c"] * 40)
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "edited"
            if rng.random() < 0.3:
                part = part[rng.randint(0, 10) :]
            words += part
        rows.append((i * 3 - 50, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, rows[7][1]), (1003, rows[7][1]), (1003, rows[9][1])]
    rows += [(None, rows[7][1]), (None, "")]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "doc_id long, text string, spans string")
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").split())
    for window in (50, 30):
        got = dedup_substrings(df.repartition(5), window).collect()
        known = [r for r in rows if r[0] is not None]
        want = brute(known, window) + [(None, len((t or "").split()), 0, " ".join((t or "").split())) for i, t in rows if i is None]
        assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
        for r in got:  # every factor stands where it says, and goes on as far as its reference does
            for f in r.factors:
                places = [(w[f.start : f.start + f.n_words], v[f.ref_start : f.ref_start + f.n_words]) for w in texts[r.doc_id] for v in texts[f.ref_doc]]
                assert f.ref_doc < r.doc_id and f.n_words >= window and any(a == b and len(a) == f.n_words for a, b in places)


def test_factors_are_greedy():
    rows = np.array([(70, 5, 3, 12), (10, 40, 3, 100), (50, 20, 3, 140), (75, 2, 3, 17), (77, 1, 4, 19), (90, 1, 4, 20)])
    assert factors(rows, 50).tolist() == [[10, 109, 3, 100], [70, 56, 3, 12], [77, 50, 4, 19], [90, 50, 4, 20]]


def test_a_whole_copy_is_one_factor(spark):
    words = [f"w{i * i % 9973}" for i in range(700)]
    rows = [(1, " ".join(words)), (2, "x y " + " ".join(words)), (3, " ".join(words[100:400]) + " z")]
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(2, 700, 1, 0)], 3: [(0, 300, 1, 100)]}


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", [n for n in ORACLES if n.startswith("op10")])
def test_sql(spark, sf_dir, name):
    assert_matches(spark, sf_dir, QUERIES[name], ORACLES[name])
