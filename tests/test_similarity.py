"""Searches through pivots and lags by transforms, against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators.similarity import lag_align, nearest_of_all, projection_shift, share_per_pick


def brute(rows, queries):
    unit = {}
    for i, v in rows:
        if v is not None:
            v = np.array(v, float) - np.mean(v)
            if (size := np.sqrt((v * v).sum())) > 0:
                unit[i] = v / size
    out = {}
    for q in queries:
        scores = {c: round(float(unit[q] @ u), 5) for c, u in unit.items() if c != q} if q in unit else {}
        if scores:
            top = max(scores.values())
            out[q] = (min(c for c, s in scores.items() if s == top), top, round(top - min(scores.values()), 5))
    return out


@pytest.mark.parametrize("spread, pivots", [(0.05, 60), (5.0, 12), (0.05, 1), (0.3, 500)])
def test_nearest_and_worst_through_pivots(spark, monkeypatch, spread, pivots):
    monkeypatch.setattr("chronoframe.operators.similarity.SLICE", 40)
    rng = np.random.default_rng(int(spread * 100) + pivots)
    middle = rng.normal(size=(12, 8))
    rows = [(i, (middle[i % 12] + rng.normal(size=8) * spread).tolist()) for i in range(600)]
    rows += [(600 + i, rows[5][1]) for i in range(90)] + [(700, None), (701, [2.0] * 8), (702, [-x for x in rows[5][1]])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>").repartition(4)
    got = {r.vec_id: r for r in nearest_of_all(df.where("vec_id % 10 = 0 or vec_id > 699"), df, "vec_id", pivots).collect()}
    want = brute(rows, [i for i, _ in rows if i % 10 == 0 or i > 699])
    assert set(got) == set(want)
    for q, (pick, score, margin) in want.items():
        assert abs(got[q].score - score) < 1.5e-5 and abs(got[q].margin - margin) < 2.5e-5, q
        if got[q].score == score:
            assert got[q].pick == pick, q
    if spread == 0.05 and pivots == 60:
        assert sum(r.met for r in got.values()) < 0.5 * len(got) * len(rows)  # the others are skipped
    none = df.where("false")
    assert nearest_of_all(none, df, "vec_id").collect() == [] == nearest_of_all(df, none, "vec_id").collect()
    assert nearest_of_all(df, df.where("vec_id > 699 and vec_id < 702"), "vec_id").collect() == []


def direct(a, b, max_lag):
    best = None
    for lag in range(-max_lag, max_lag + 1):
        pairs = [(x, y) for i, x in a for j, y in b if j == i + lag]
        if len(pairs) >= 3:
            x, y = np.array(pairs, float).T
            if x.std() > 0 and y.std() > 0:
                r = round(float(np.corrcoef(x, y)[0, 1]), 6)
                best = max(best, (r, -abs(lag), lag)) if best else (r, -abs(lag), lag)
    return best and (best[2], best[0])


@pytest.mark.parametrize("max_lag, block", [(0, None), (3, None), (17, 20), (40, None)])
def test_lag_against_direct_sums(spark, max_lag, block):
    rng = np.random.default_rng(max_lag)
    recs = {}
    for k in range(5):
        v = rng.normal(size=160).round(2) + 1000 * k
        a = [(i - 30, float(x)) for i, x in enumerate(v) if rng.random() < 0.7]
        b = [(i - 30 + 5 * k - 9, float(x + rng.normal() * 0.3)) for i, x in enumerate(v) if rng.random() < 0.7]
        recs[k] = a, b
    recs[5] = [(i, 7.5) for i in range(9)], [(i, float(i)) for i in range(9)]
    recs[6] = [(0, 1.0), (1, 2.0)], [(0, 1.0), (1, 2.0)]
    recs[7] = recs[1][0] + recs[1][0][:20], recs[1][1]  # repeated bins
    recs[8] = [(1, 1.0)], []
    frame = lambda side: spark.createDataFrame([(k, *r) for k, pair in recs.items() for r in pair[side]] + [(0, 3, None), (0, None, 1.0)], "k int, bin long, v double").repartition(3)
    got = {r.k: (r.lag, r.r) for r in lag_align(frame(0), frame(1), ["k"], max_lag, block).collect()}
    want = {k: w for k, (a, b) in recs.items() if (w := direct(a, b, max_lag))}
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6, (k, got[k], want[k])


def test_a_long_lag(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=6000).cumsum()
    a = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, bin long, v double")
    got = lag_align(a, a.withColumn("bin", F.col("bin") + 777), ["k"], 1000).collect()
    assert [tuple(r) for r in got] == [(1, 777, 1.0)]


def test_projection_shift(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=12).tolist(), rng.normal(size=12).tolist()) for _ in range(40)]
    rows += [(rows[0][0], rows[0][0][3:] + [0.0] * 3), ([1.0] * 4, [1.0] * 4), ([1.0, 2.0], [2.0, 1.0]), (None, [1.0]), ([], [])]

    def shift(a, b, most):
        a, b = np.array(a) - np.mean(a), np.array(b) - np.mean(b)
        best, at = -1e18, 0
        for k in range(-most, most + 1):
            n = max(len(a) - abs(k), 0)
            x, y = a[max(-k, 0) :][:n], b[max(k, 0) :][:n]
            s = float((x * y).sum()) / (float(np.sqrt((x * x).sum() * (y * y).sum())) + 1e-9)
            best, at = (s, k) if s > best else (best, at)
        return at

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<double>, b array<double>")
    got = {r.i: r.s for r in df.select("i", projection_shift("a", "b", 5).alias("s")).collect()}
    for i, (a, b) in enumerate(rows):
        if a is None:
            assert got[i] is None
        elif a and max(a) > min(a):
            assert got[i] == shift(a, b, 5), i


def test_share_per_pick(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 0.0)], "k string, pick int, seconds double")
    assert sorted(tuple(r) for r in share_per_pick(df, ["k"], "pick", "seconds").collect()) == [("a", 1, 3.0, 0.75), ("a", 2, 1.0, 0.25), ("b", 1, 0.0, None)]
    assert sorted(tuple(r)[:2] for r in share_per_pick(df, [], "pick", "seconds").collect()) == [(1, 3.0), (2, 1.0)]
