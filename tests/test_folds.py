"""Folds over chunks of a recording, against one plain loop over all of it."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import islands as I
from chronoframe.operators.folds import Spacing, fold_in_chunks


def series(seed, n=400):
    rng = random.Random(seed)
    t, out = 0.0, []
    for _ in range(n):
        t += rng.choice([0.0, 0.25, 0.5, 1.0, 3.0, 20.0] if seed % 2 else [1.0])
        out.append((t, float(rng.randrange(-12, 13)) if seed % 3 else 10.0 * (len(out) // 7 % 2) - len(out) * 0.1))
    return out


def rows_of(spark, columns, *recordings):
    return spark.createDataFrame([(k, *r) for k, rec in recordings for r in rec], columns).repartition(4)


CHUNKS = [None, 40.0, 7.0]


def thinned(times, gap):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("gap", [0.0, 1.5, 7.3, 100.0])
def test_thin(spark, gap):
    recs = [(k, [(t,) for t, _ in series(s)]) for k, s in (("a", 1), ("b", 2), (None, 3))] + [("one", [(5.0,)]), ("far", [(-1e6,), (1e6,)])]
    df = rows_of(spark, "k string, t double", *recs)
    df = df.union(spark.createDataFrame([("a", None), ("none", None)], df.schema))
    want = sorted(((k, t) for k, r in recs for t in thinned([x[0] for x in r], gap)), key=repr)
    for chunk in CHUNKS:
        assert sorted((tuple(r) for r in I.thin(df, ["k"], gap, chunk=chunk).collect()), key=repr) == want, chunk
    assert I.thin(df.where("false"), ["k"], gap, chunk=3.0).collect() == []


@pytest.mark.parametrize("per", [1, 5, 1000])
def test_spacing_of_places_that_fall(spark, per):
    rng = random.Random(per)
    at = [i * 0.4 + rng.randrange(-5, 6) for i in range(300)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(at)], "k int, i long, at double").repartition(3)
    want, last = [], None
    for i, x in enumerate(at):
        if last is None or x - last >= 2:
            want.append(i)
            last = x
    got = fold_in_chunks(df, ["k"], ["i"], F.floor(F.col("i") / per).cast("long"), Spacing("at", 2.0, "i"), "i long")
    assert sorted(r.i for r in got.collect()) == want


def zigzag(rows, step):
    """Reads every row from the last turn on anew."""
    out, start, way, since = [], rows[0], 0, 0
    i = 0
    while i < len(rows):
        part = rows[since : i + 1]
        top, low = max(part, key=lambda r: r[1]), min(part, key=lambda r: r[1])
        turn = top if way >= 0 and top[1] - rows[i][1] >= step else low if way <= 0 and rows[i][1] - low[1] >= step else None
        if turn is not None:
            if turn[0] > start[0]:
                out.append((*start, *turn))
            start, way, since = turn, -1 if turn is top else 1, i
        i += 1
    return out + ([(*start, *rows[-1])] if rows[-1][0] > start[0] else [])


@pytest.mark.parametrize("step", [3.0, 11.0, 100.0])
def test_legs(spark, step):
    recs = []
    for k in range(6):
        rows = dict(series(k, 250))
        recs.append((k, sorted(rows.items())))
    recs += [(6, [(1.0, 2.0)]), (7, [(float(i), -0.5 * i) for i in range(100)]), (8, [(float(i), [0.0, 12.0][i % 2]) for i in range(50)])]
    df = rows_of(spark, "k int, t double, level double", *recs)
    want = sorted((k, *leg) for k, r in recs for leg in zigzag(r, step))
    for chunk in CHUNKS:
        assert sorted(tuple(r) for r in I.legs(df, ["k"], "level", step, chunk=chunk).collect()) == want, chunk


@pytest.mark.parametrize("seed", range(4))
def test_drop_covered(spark, seed):
    rng = random.Random(seed)
    rows = [(i, a, a + rng.choice([0, 0, 1, 2, 30]), rng.random() < 0.6) for i in range(150) for a in [float(rng.randrange(200))]]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, id long, start double, stop double, media boolean").repartition(3)
    edges = sorted({x for r in rows for x in r[1:3]})

    def bare(r):
        parts = [(a, b) for a, b in zip(edges, edges[1:]) if r[1] <= a and b <= r[2]]
        return any(all(o is r or not (o[1] <= a and b <= o[2]) for o in rows) for a, b in parts)

    last, kept = None, []
    for r in sorted((r for r in rows if r[3] or bare(r)), key=lambda r: (r[1], not r[3], r[0], r[2])):
        if last is None or r[1] >= last[2] or last[1] >= r[2]:
            kept.append(r[0])
            last = r
    for chunk in CHUNKS:
        assert sorted(r.id for r in I.drop_covered(df, ["k"], "id", chunk=chunk).collect()) == sorted(kept), chunk


@pytest.mark.parametrize("k, spacing", [(1, 5.0), (4, 2.0), (9, 30.0)])
def test_spaced_top_k(spark, k, spacing):
    rng = random.Random(k)
    recs = [(r, [(float(rng.randrange(300)), float(rng.randrange(20)), i) for i in range(n)]) for r, n in ((1, 500), (2, 3), (None, 60))]
    df = rows_of(spark, "k int, t double, s double, id long", *recs)
    want = []
    for key, rows in recs:
        picked = []
        for t, s, i in sorted(rows, key=lambda r: (-r[1], r[0], r[2])):
            if len(picked) < k and all(abs(t - p) >= spacing for p, _ in picked):
                picked.append((t, i))
        want += [(key, n + 1, i) for n, (_, i) in enumerate(picked)] if key is not None else []
    got = I.spaced_top_k(df.where("k is not null"), ["k"], "id", "s", spacing, k)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert I.spaced_top_k(df.where("false"), ["k"], "id", "s", spacing, k).collect() == []


@pytest.mark.parametrize("least", [0.0, 3.0, 50.0])
def test_leader_runs(spark, least):
    rng = random.Random(7)
    recs = [(k, [(float(t), rng.choice(["x", "y", "y", "z", None])) for t in sorted(rng.sample(range(400), 120))]) for k in range(5)] + [(9, [(1.0, None)]), (10, [(1.0, "x")])]
    df = rows_of(spark, "k int, t double, leader string", *recs)
    want = defaultdict(list)
    for k, rows in recs:
        runs = []
        for t, who in rows:
            if who is not None and (not runs or runs[-1][1] != who):
                runs.append([t, who])
        spans = [[a, b, who] for (a, who), b in zip(runs, [t for t, _ in runs[1:]] + [rows[-1][0]])]
        kept = []
        for a, b, who in spans:
            if kept and (kept[-1][2] == who or b - a < least):
                kept[-1][1] = b
            elif kept and kept[-1][1] - kept[-1][0] < least:
                kept[-1] = [a, b, who]
            else:
                kept.append([a, b, who])
        want[k] = [tuple(x) for x in kept if x[1] - x[0] >= least]
    got = defaultdict(list)
    for r in I.leader_runs(df, ["k"], least).orderBy("start").collect():
        got[r.k].append((r.start, r.stop, r.leader))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_a_long_recording_spreads_over_tasks(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), (F.col("id") * 0.5).alias("t"))
    got = I.thin(df, ["k"], 1.25, chunk=5_000.0)
    assert got.agg(F.count("*"), F.max("t")).first()[:] == (333_334, 499_999.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "_c" in plan
