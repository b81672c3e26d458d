import collections
import math
import random
import re

import numpy as np
import pytest

from chronoframe.llm.ball_tree import BallTree, index_terms, rank_documents, search
from chronoframe.llm.entries import ORACLES, QUERIES
from tests.oracle import assert_matches

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(i, collections.Counter(terms(text))) for i, text in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if lost else i, -s) for r, (s, lost, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def prose(rng, words, n):
    return " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(n))


def test_brute_force_with_odd_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}é" if i % 3 else f"W{i}" for i in range(300)]
    docs = [(i, prose(rng, words, rng.randrange(1, 80))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(5, "w1é again"), (5, "w1é again"), (None, docs[7][1]), (None, "solo"), (2000, None), (2001, ""), (2002, " .,- "), (2003, "w1é " * 30_000), (2004, "\u0085  x")]
    items = [(i, prose(rng, words, 12)) for i in range(30)]
    items += [(90, docs[7][1]), (91, None), (92, ""), (93, "nowhere"), (94, "solo SOLO"), (95, "\u0085 "), (3, items[3][1]), (3, items[3][1]), (None, "w1é"), (96, docs[9][1] * 40)]
    rng.shuffle(docs)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, key string").repartition(5)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, df int")
    assert sorted((tuple(r) for r in rank_documents(d, b).collect()), key=repr) == brute(docs, items)
    assert rank_documents(d, b.where("false")).count() == 0 and rank_documents(d.where("false"), b).count() == 0
    assert rank_documents(d.where("text is null"), b).count() == 0


def test_blocks_of_queries_and_other_k(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(200)]
    docs, items = [(i, prose(rng, words, 30)) for i in range(200)], [(i, prose(rng, words, 9)) for i in range(20)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(str(i), x) for i, x in items], "key string, text string")
    monkeypatch.setattr("chronoframe.llm.ball_tree.query_blocks.__defaults__", (200,))
    got = search(index_terms(d), t, 3)
    assert sorted(((int(r.key), r.rank, r.doc_id, r.score) for r in got.collect()), key=repr) == brute(docs, items, 3)


@pytest.mark.parametrize("copies", [1, 40])
def test_bounds_hold_and_prune(copies):
    rng = np.random.default_rng(copies)
    topics = [rng.choice(400, 40, replace=False) for _ in range(12)]
    rows = []
    for i in range(1200 // copies):
        columns = np.unique(rng.choice(topics[i % 12], 15))
        rows += [(columns, rng.integers(1, 1_000_000, len(columns)))] * copies
    start, columns, values = np.cumsum([0, *(len(c) for c, _ in rows)]), *(np.concatenate([r[k] for r in rows]) for k in (0, 1))
    tree = BallTree(start, columns, values, 400)
    dense = np.zeros((len(rows), 400), np.int64)
    for i, (c, v) in enumerate(rows):
        dense[i, c] = v
    scored = 0
    for q in range(30):
        terms_ = np.sort(rng.choice(topics[q % 12], 8, replace=False))
        weights = rng.integers(0, 9000, 8)
        exact = dense[:, terms_] @ weights
        bound = tree.bounds(terms_, weights)
        for at in range(len(tree.low)):
            assert bound[at] >= exact[tree.order[tree.low[at] : tree.high[at]]].max()
        best, found = [0], {}

        def take(r, s):
            found.update(zip(r.tolist(), s.tolist()))
            best.extend(s.tolist())
            return sorted(best)[-10:][0]

        scored += tree.search(terms_, weights, 1, take)
        assert all(exact[r] == s for r, s in found.items())
        assert sorted(found.values())[-10:] == sorted(exact.tolist())[-10:]
    assert scored < 0.5 * 30 * len(rows)


def test_sql(spark, sf_dir):
    assert_matches(spark, sf_dir, QUERIES["op11_ball_tree"], ORACLES["op11_ball_tree"])
