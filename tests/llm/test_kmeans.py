import hashlib

import numpy as np
import pytest

from chronoframe.llm.entries import ORACLES, QUERIES
from chronoframe.llm.kmeans import cluster, clustered, integer_vectors
from tests.oracle import assert_matches

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def scan(v, centroids, rounds):
    """Rounds of full scans."""
    centroids = [list(map(int, c)) for c in centroids]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j))
    for _ in range(rounds):
        own = [near(x) for x in v]
        for j in range(len(centroids)):
            if mine := [x for x, o in zip(v, own) if o == j]:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    own = [near(x) for x in v]
    return own, [far(x, centroids[o]) for x, o in zip(v, own)], centroids


@pytest.mark.parametrize("spread", [0, 1, 300])
def test_bounds_give_the_full_scan_with_fewer_distances(spark, spread):
    rng = np.random.default_rng(spread)
    middle = rng.integers(-40, 40, (6, 5)) * (spread or 1)
    v = [[int(x) for x in middle[i % 6] + rng.integers(-3, 4, 5)] for i in range(600)]
    v += v[:40]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, v array<int>").repartition(5)
    start = np.array(v[:7], np.int64)
    rows, history = cluster(df, start, 6)
    rows = sorted(rows.collect())
    own, far, centroids = scan(v, start, 6)
    assert [r.cluster for r in rows] == own and [r.distance for r in rows] == far
    assert history[-1].tolist() == centroids and len(history) == 7
    assert all(r.evaluated <= 7 * 7 + 1 for r in rows)
    if spread == 300:
        assert sum(r.evaluated for r in rows) < 0.5 * len(rows) * 7 * 7


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] * 64), (107, [-1e300] * 64)]
    rows = [*good, *bad, good[3], (None, good[4][1]), (None, [0.5] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = clustered(df).collect()
    kept = [r for r in rows if r not in bad]
    ints = [[int(np.floor(64 * x)) for x in r[1]] for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"1:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), ints[i]))[:16]
    own, far, centroids = scan(ints, [ints[i] for i in first], 3)
    want = sorted([(str(r[0]), o, d) for r, o, d in zip(kept, own, far)])
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    assert {r.inertia for r in got} == {sum(far)}
    for r in got:
        assert r.cluster_inertia == sum(d for o, d in zip(own, far) if o == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(7, [0.1] * 64, "x", 1)] * 3, SCHEMA)
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in clustered(one).collect()] == [(7, 0, 0, 0)] * 3
    none = clustered(one.where("false"))
    assert none.count() == 0 and none.columns == clustered(one).columns
    assert integer_vectors(one).first().v == [6] * 64


def test_sql(spark, sf_dir):
    assert_matches(spark, sf_dir, QUERIES["op12_kmeans"], ORACLES["op12_kmeans"])
