import random

import numpy as np
import pyarrow as pa

from chronoframe.llm import common, ngram_join
from chronoframe.llm.entries import ORACLES, QUERIES
from tests.oracle import assert_matches


def brute(rows):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, rng.choice([12, 60, 400])))
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        extra = rng.integers(0, int(n * 0.25) + 1)
        cut = int(rng.integers(0, extra + 1))
        a = np.unique(np.append(common, rng.integers(0, 2**63, cut, dtype=np.uint64)))
        b = np.unique(np.append(common, rng.integers(0, 2**63, extra - cut, dtype=np.uint64)))
        if 100 * n >= 80 * len(np.union1d(a, b)):
            at, sig = ngram_join.part_enum([a, b])
            assert np.array_equal(a, b) or len(np.intersect1d(sig[at == 0], sig[at == 1]))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    common = [rng.choice(vocabulary) for _ in range(25)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 9, 30, 80, 200]))] for _ in range(25)]
    rows = []
    for i in range(320):
        words = list(rng.choice(base[:6] if i % 2 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words += common
        text = rng.choice([" ", "\n", "  "]).join(words)
        rows.append((i * 7 - 99, text.upper() if rng.random() < 0.2 else text))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string").repartition(7)
    assert sorted(map(tuple, ngram_join.ngram_components(df).collect())) == brute(rows)
    kept = sorted(r.doc_id for r in ngram_join.drop_near_copies(df).collect())
    assert kept == sorted({c for _, _, c in brute(rows)})


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_components(empty).collect() == []
    text = "a b c d e f g"
    df = spark.createDataFrame([(3, text), (3, text), (1, text), (9, "other words")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_components(df).collect())) == [(1, 3, 1), (3, 3, 1), (3, 3, 1), (9, 1, 9)]


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rng.integers(0, 90, 200)]
    at, sig = ngram_join.part_enum(sets)
    for i, s in enumerate(sets):
        assert sorted(sig[at == i].tolist()) == sorted(ngram_join.part_enum([s])[1].tolist())
        assert len(s) > 3 or not (at == i).any()


def test_word_hashes(monkeypatch):
    rng = random.Random(4)
    texts = [rng.choice([b"", b" ", b"\x0b a", b"ab\tc\xc3\xa9 "]) + b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += [b"x" * 300 + b" a b " + b"y" * 500, b" ", b"a\fb"]
    want, counts = common.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    words = [w for t in texts for w in t.split()]
    assert len(set(want.tolist())) == len(set(words)) == len(set(zip(words, want.tolist())))
    monkeypatch.setattr(common, "_SLAB", 64)
    got, counts = common.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert [g for g, w in zip(got.tolist(), words) if len(w) <= 64] == [g for g, w in zip(want.tolist(), words) if len(w) <= 64]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 500, int(n), dtype=np.uint64)) for n in rng.integers(1, 300, 2))
        x, y = ngram_join.parities(a), ngram_join.parities(b)
        size = min(len(x), len(y))
        assert np.bitwise_count(ngram_join.folded(x, size) ^ ngram_join.folded(y, size)).sum() <= len(np.setxor1d(a, b))


def test_runs_of_whole_groups(monkeypatch):
    rng = random.Random(3)
    rows = [(s, 0, j) for s in range(60) for j in range(rng.randint(1, 2)) for _ in range(rng.randint(1, 12))]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("sig", "i", "j"))})
    monkeypatch.setattr(ngram_join, "PAIRS", 100)
    parts = [list(zip(*(p.column(c).to_pylist() for c in ("sig", "i", "j")))) for p in ngram_join._runs(table)]
    assert len(parts) > 5 and [r for p in parts for r in p] == rows
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
    assert list(ngram_join._runs(table.slice(0, 0))) == []


def test_unlike_documents_of_one_signature_meet_in_blocks(spark, monkeypatch):
    """Documents that share four fifths of half their text: many common signatures, few links, blocks of 8."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "FAN", 4)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(90)]
    rows = [(i, " ".join(common + [f"u{i // 2}-{k}" for k in range(24 if i % 3 else 40)])) for i in range(120)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ngram_join.ngram_components(df).collect())) == brute(rows)


def test_null_ids_and_different_texts_of_one_id(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(None, text), (None, text), (7, text), (4, text + " q"), (7, "one two three four five six"), (9, "one two three four five six"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.ngram_components(df).collect()), key=str)
    assert got == sorted([(None, 12, None), (None, 12, None), (7, 12, 4), (4, 13, 4), (7, 2, 4), (9, 2, 4), (2, 0, 2)], key=str)
    kept = ngram_join.drop_near_copies(spark.createDataFrame([*rows, (4, text + " q")], "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, text), (None, text), (4, text + " q"), (2, None)], key=str)


def test_sql(spark, sf_dir):
    assert_matches(spark, sf_dir, QUERIES["op4_ngram_join"], ORACLES["op4_ngram_join"])
