import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoframe.llm.entries import ORACLES, QUERIES
from chronoframe.llm.spotsigs import ANCHORS, CHAIN, _buckets, spot_pairs, spots, with_next
from tests.oracle import assert_matches


def test_next_document(spark):
    rng = random.Random(1)
    ids = sorted({rng.choice([rng.randint(-5000, 9000), rng.randint(2**33, 2**33 + 3000), -(2**40) + rng.randint(0, 9)]) for _ in range(400)})
    rows = [(i, f"t{i}") for i in ids] + [(ids[5], "zz"), (ids[6], None)]
    rows += [(None, rng.choice(["", "a", "b", "é", "😀"]) + rng.choice(["", "a", "é", "zz"])) for _ in range(60)]
    rng.shuffle(rows)
    texts = F.coalesce("text", F.lit("")).alias("text")
    with_texts = lambda rows: with_next(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", texts), {"more": F.concat("text", F.lit("!"))})
    assert all(r.more == r.text + "!" and r.next_more == r.next_text + "!" for r in with_texts(rows).collect())
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.text, r.next_text) for r in with_texts(rows).collect()), key=key)
    order = sorted(((i, t or "") for i, t in rows), key=key)
    assert got == sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=key)
    assert with_texts([(1, None)]).collect() == [(1, "", "!", "", "!")]
    assert with_texts([]).collect() == []


def test_spots(spark):
    texts = ["", "###", "The cat sat on the mat, of course!", "no anchor-words HERE", "the the of", "x"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(spots(F.col("t"))).collect()]
    assert all(got) and len(set(map(tuple, got))) == len(texts) and len(got[2]) == 3


def naive(text):
    """Spots by plain loops: the words after an anchor or the start, up to the next anchor, three at most."""
    words = re.findall(r"[^\W_]+", text.lower())
    marks = [k for k, w in enumerate(words) if w in ANCHORS]
    if marks:
        runs = [words[a:b] for a, b in zip([0, *(k + 1 for k in marks)], [*marks, len(words)])]
    else:
        runs = [words[k : k + CHAIN] for k in range(max(1, len(words) - CHAIN + 1))]
    chains = ["  ".join(r[:CHAIN]) for r in runs if r] or [text]
    return sorted({hashlib.md5(c.encode()).hexdigest()[:10] for c in chains})


def test_against_naive_spots(spark):
    rng = random.Random(9)
    words = ["the", "a", "an", "and", "of", "la", "für", "Über", "x1", "cat", "hat", "an-d", "theme", "ofen", "é"]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choices(words if i % 3 else words[7:], k=rng.randint(0, 30))) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", spots(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.s == naive(r.t), r.t


def test_texts_without_anchors_are_fingerprinted_whole(spark):
    start, rest = "xa xb xc ", [" ".join(f"{c}{i}" for i in range(400)) for c in "pq"]
    df = spark.createDataFrame([(i, start + r) for i, r in enumerate(rest)], "i int, t string").orderBy("i")
    a, b = (set(r[0]) for r in df.select(spots(F.col("t"))).collect())
    assert len(a) == len(b) == 401 and len(a & b) == 1


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(["the", "of", "la"]) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(5, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {}
    for r in df.select("doc_id", spots(F.col("text")).alias("s")).orderBy("doc_id").collect():
        prints.setdefault(frozenset(r.s), r.doc_id)
    want = {tuple(sorted((a, b))) for s, a in prints.items() for t, b in prints.items() if a < b and len(s & t) >= 0.8 * len(s | t)}
    assert {(r.a, r.b) for r in spot_pairs(df).collect()} == want and want


def test_sql(spark, sf_dir):
    assert_matches(spark, sf_dir, QUERIES["op6_spotsigs"], ORACLES["op6_spotsigs"])


@pytest.mark.parametrize("size, bucket, cells", [(400, 8, 16), (400, 8, 512), (400, 3, 4), (3, 8, 16), (1, 8, 16)])
def test_next_document_for_any_ids(spark, monkeypatch, size, bucket, cells):
    """Dense, sparse, clustered, repeated and negative ids: the next row by (doc_id, text), and no bucket of most rows."""
    monkeypatch.setattr("chronoframe.llm.spotsigs.BUCKET", bucket)
    monkeypatch.setattr("chronoframe.llm.spotsigs.CELLS", cells)
    rng = random.Random(size + bucket)
    for ids in ([*range(size)], [rng.getrandbits(64) - 2**63 for _ in range(size)], [10**15 + i if i % 4 else -i * 10**12 for i in range(size)], [i // 9 for i in range(size)]):
        rows = [(i, f"{rng.choice('abc')} text {k}") for k, i in enumerate(ids)] + [(None, f"x{k}") for k in range(size // 40)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        got = {(r.doc_id, r.text): r.next_text for r in with_next(docs, {}).collect()}
        assert got == {r: want[(k + 1) % len(want)][1] for k, r in enumerate(want)}
        if size == 400 and cells == 16:
            cell, piece = _buckets(docs)
            most = docs.where("doc_id is not null").groupBy(cell.alias("c"), piece.alias("p")).count().agg(F.max("count")).first()[0]
            assert most <= 60
