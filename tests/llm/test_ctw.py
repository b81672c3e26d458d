import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from chronoframe.llm import ctw
from chronoframe.llm.entries import QUERIES

D = ctw.DEPTH


def naive_scores(rows):
    """Context-tree weighting by its recursive definition, node by node."""
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(t):
        data = b"\0" * D + t + b"\0"
        for k in range(D, len(data)):
            context = data[k - D : k]
            for j in range(8):
                yield context, (j, data[k] >> (8 - j)), data[k] >> (7 - j) & 1

    for t in train:
        for context, prefix, bit in steps(t):
            for d in range(D + 1):
                counts[context[D - d :], prefix][bit] += 1
                if d < D:
                    children[context[D - d :], prefix].add(context[D - d - 1 :])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(context, prefix):
        key = context, prefix
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if len(context) == D else np.logaddexp(own, sum(weighted(c, prefix) for c in children[key])) - math.log(2)
        return memo[key]

    def one(context, prefix, d=0, last=0.5):
        key = context[D - d :], prefix
        n0, n1 = counts.get(key, (0, 0))
        if not n0 + n1:
            return last
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == D:
            return own
        w = math.exp(kt(n0, n1) - weighted(*key)) / 2
        return w * own + (1 - w) * one(context, prefix, d + 1, own)

    return [sum(math.log10(p if bit else 1 - p) for c, prefix, bit in steps((t or "").encode()) for p in [one(c, prefix)]) for _, t in rows]


def naive_base(rows):
    tokens = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").encode().split() + [b""]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for _, t in rows]


def test_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(ctw, "STEP_BYTES", 300)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "an", "éa", "ing", "x\ty", "tion"]) + rng.choice(["", "er", "é"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (101, ""), (102, "zzz \0 q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.score_texts(df, ctw.held_out(df.doc_id)).collect())
    want = sorted((i, *b, s) for (i, _), b, s in zip(rows, naive_base(rows), naive_scores(rows)))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-6), (g, w)


def test_equal_rows_spread(spark, monkeypatch, tmp_path):
    rows = [(None, "the same words again and again")] * 300 + [(i, f"other words {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/d")
    once = sorted(((r.doc_id, r.base_score, round(r.score, 6)) for r in ctw.score_texts(df, ctw.held_out(df.doc_id)).collect()), key=str)
    monkeypatch.setattr(ctw, "BUCKET_BYTES", 1000)
    for docs in (df, spark.read.parquet(f"{tmp_path}/d")):
        dealt = ctw.deal(docs, ctw.held_out(docs.doc_id))
        hot = [r.n for r in dealt.where("doc_id is null").groupBy("bucket").agg({"*": "count"}).toDF("bucket", "n").collect()]
        assert len(hot) > 8 and max(hot) < 60 and sum(hot) == 300
        assert sorted(((r.doc_id, r.base_score, round(r.score, 6)) for r in ctw.score_texts(docs, ctw.held_out(docs.doc_id)).collect()), key=str) == once


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score_texts(df, ctw.held_out(df.doc_id)).collect() == []


def test_held_out_texts(spark, sf_dir):
    rows = [r for r in QUERIES["op8_ctw"](spark, sf_dir).collect() if r.held_out]
    size = sum(r.score / -math.log10(2) / r.bits_per_byte for r in rows)
    assert rows and sum(-r.score for r in rows) / math.log10(2) / size < 3.0
