import numpy as np

from chronoframe.operators.joins import nearest_vector
from chronoframe.operators.ordering import time_order
from chronoframe.plans import QUERIES


def brute(rows, queries, same=lambda a, b: True):
    v = {i: np.array(x, float) - np.mean(np.array(x, float)) for i, x in rows}
    out = {}
    for q in queries:
        scores = {c: round(float(v[q] @ v[c] / np.sqrt((v[q] @ v[q]) * (v[c] @ v[c]))), 5) for c in v if c != q and same(q, c)}
        out[q] = (max(scores.values()), max(scores.values()) - min(scores.values()), scores)
    return out


def agree(got, want):
    assert {r.vec_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        score, margin, scores = want[r.vec_id]
        assert abs(r.score - score) < 3e-5 and abs(r.margin - margin) < 3e-5 and abs(scores[r.pick] - score) < 3e-5


def test_every_hundredth_row_against_all(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert len(want) == len(rows) // 100
    agree(QUERIES["c32_nearest_vector"](spark, sf_dir).collect(), want)


def test_aligned_key_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(i, rows[7][1]) for i in (50, 47)]  # two equal candidates of 7
    df = spark.createDataFrame([(i, i % 2, x) for i, x in rows], "vec_id long, at int, vec array<double>")
    agree(nearest_vector(df, df, ["at"], "vec_id").collect(), brute(rows, [i for i, _ in rows], lambda a, b: a % 2 == b % 2))
    picks = {r.vec_id: r.pick for r in nearest_vector(df, df, [], "vec_id").collect()}
    assert picks[7] == 47 and picks[50] == 7 and picks[47] == 7


def test_time_order(spark):
    df = spark.createDataFrame([(1, 2.0, 1, "a"), (1, 1.0, 0, "b"), (1, 1.0, 1, "c"), (1, None, 1, "d"), (2, 5.0, 0, "e")], "k int, t double, media int, id string")
    got = {r.id: r.pos for r in time_order(df, ["k"], "t", -df.media, "id").collect()}
    assert got == {"c": 1, "b": 2, "a": 3, "e": 1}
