import numpy as np

from chronoframe.llm import mixing
from chronoframe.llm.entries import QUERIES


def waterfill(sizes, weights, cap=3.0):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = share * weights[i]
            return target
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def check(rows, slack):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = waterfill(sizes, [i % 3 + 1 for i in range(len(names))])
    for s, size, target in zip(names, sizes, want):
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 * max(1, target) for r in by[s])
        taken = sum(r["size"] * r.copies for r in by[s])
        assert abs(taken - target) <= slack * max(r["size"] for r in by[s]) + 1e-6, (s, taken, target)
        assert all(0 <= r.copies <= 3 for r in by[s])


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 3000):
        p, size = rng.random(n), rng.integers(0, 400, n).astype(float)
        q = mixing.flight(p, size, np.random.default_rng(2))
        assert abs(q.sum() - p.sum()) < 1e-5 and abs((q * size).sum() - (p * size).sum()) < 1e-2
        assert ((q > 0) & (q < 1)).sum() <= 2
    same = mixing.flight(np.full(101, 0.3), np.full(101, 7.0), np.random.default_rng(2))
    assert abs(same.sum() - 30.3) < 1e-6 and ((same > 0) & (same < 1)).sum() <= 2


def test_sources(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["hot", "b", "c", None, "Ω", "z"][min(5, int(rng.exponential(1.2)))], i) for i in range(1500)]
    rows += [(5000, None, "empty", 1), (5001, "", "empty", 1), (5002, "one", "tiny", 1), (7, rows[7][1], rows[7][2], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    one = sorted(mixing.mix_sources(df).collect(), key=str)
    check(one, 1)
    again = sorted(mixing.mix_sources(df.repartition(13)).collect(), key=str)
    assert one == again
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    check(mixing.mix_sources(df).collect(), 1)


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_mixing"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r["size"] == len(texts[r.doc_id].split()) and r.taken <= 3 * r["size"] for r in rows)
    # each source's words come near its target: within the longest document of the source
    size, taken, longest, stated = {}, {}, {}, {}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows:
        s = source[r.doc_id]
        size[s], taken[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r.taken
        longest[s], stated[s] = max(longest.get(s, 0), r["size"]), (r.source_size, r.target)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, full = {s: 1 + k % 3 for k, s in enumerate(names)}, {}
    while True:
        rest, share = sum(size.values()) - sum(full.values()), sum(weight[s] for s in names if s not in full)
        over = {s: 3 * size[s] for s in names if s not in full and rest * weight[s] / share > 3 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    for s in names:
        want = full.get(s, rest * weight[s] / share if s not in full else 0)
        assert stated[s][0] == size[s] and abs(stated[s][1] - want) < 1e-6 * max(want, 1) and abs(taken[s] - want) <= longest[s]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op7_mixing"](spark, sf_dir).collect()))


def test_rows_without_an_id_are_dealt_into_buckets(spark, monkeypatch):
    rows = [(None, "w " * (i % 50), "s") for i in range(4000)] + [(i, "w " * (i % 40), "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    check(got, 1)
    assert len(got) == len(rows)
