import random

from chronoframe.llm import decontaminate as dc
from chronoframe.llm.entries import QUERIES


def nearest(item, text):
    """Plain dynamic programme: least edits of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_match():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.randint(0, 5) for _ in range(rng.randint(1, 80))]
        text = [rng.randint(0, 5) for _ in range(rng.randint(0, 90))]
        assert dc.edit_match(item, text)[0] == nearest(item, text)


def corpus(rng, edits):
    vocabulary = [f"w{i}" for i in range(3000)]
    usual = ["the", "of", "and", "la", "der"]
    word = lambda: rng.choice(usual) if rng.random() < 0.4 else rng.choice(vocabulary)
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(20)]
    docs, truth = [], set()
    for i in range(80):
        words = [word() for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            k = rng.randrange(len(items))
            leak = items[k][1].split()
            for _ in range(edits(len(leak))):
                at, how = rng.randrange(len(leak)), rng.random()
                leak[at : at + 1] = [] if how < 0.2 and len(leak) > 5 else [word(), leak[at]] if how < 0.4 else [word()]
            at = rng.randint(0, len(words))
            words[at:at] = leak
            truth.add((i, k))
        docs.append((i, rng.choice(["", "So, "]) + " ".join(words).replace("w1", "W1") + "!"))
    return items, docs, truth


def test_recall_and_exactness(spark):
    for seed, edits, least in ((2, lambda n: 0, 1.0), (3, lambda n: int(0.1 * n), 0.97), (4, lambda n: int(0.2 * n), 0.9)):
        items, docs, truth = corpus(random.Random(seed), edits)
        df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int").repartition(4)
        got = dc.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
        words = {i: dc.normalised(t) for i, t in items}
        texts = {i: dc.normalised(t) for i, t in docs}
        want = {(d, i) for d in texts for i in words if nearest(words[i], texts[d]) <= dc.most_edits(len(words[i]))}
        assert truth <= want
        pairs = {(r.doc_id, r.item_id) for r in got}
        assert pairs <= want and len(pairs) >= least * len(want), (seed, len(pairs), len(want))
        assert all(nearest(words[r.item_id], texts[r.doc_id][r.start_word : r.end_word]) == r.distance for r in got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x a b c"), (3, "x a b c"), (4, "a b d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "A, b c!"), (2, ""), (3, None)], "item_id long, text string")
    assert sorted(map(tuple, dc.find_leaks(docs, bench).collect())) == [(3, 1, 0, 1, 4)] * 2
    assert sorted(r.doc_id for r in dc.drop_leaking(docs, bench).collect()) == [1, 2, 4]
    assert dc.find_leaks(docs, bench.limit(0)).collect() == [] and dc.find_leaks(docs.limit(0), bench).collect() == []


def test_blocks(spark, monkeypatch):
    items, docs, _ = corpus(random.Random(5), lambda n: 2)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.find_leaks(df, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(dc, "WINDOWS", 7)
    assert len(list(dc._blocks(bench))) > 1
    assert sorted(map(tuple, dc.find_leaks(df, bench).collect())) == whole and whole


def test_a_very_long_item(spark, monkeypatch):
    rng = random.Random(9)
    long = [f"w{rng.randrange(2000)}" for _ in range(1500)]
    edited = [w if rng.random() > 0.05 else "other" for w in long]
    texts = [(1, "before " + " ".join(long)), (2, " ".join(edited) + " after"), (3, " ".join(long[:700]))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    monkeypatch.setattr(dc, "WINDOW_WORDS", 40_000)  # 26 windows at once
    assert [(r.doc_id, r.distance) for r in sorted(dc.find_leaks(docs, bench).collect())] == [(1, 0), (2, nearest(long, edited))]


def test_query(spark, sf_dir):
    texts = {r.doc_id: b" ".join(dc.normalised(r.text)).decode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: b" ".join(dc.normalised(r.text)).decode() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, w in items.items() if f" {w} " in f" {t} "}
    assert exact <= {(r.doc_id, r.item_id) for r in QUERIES["op5_decontaminate"](spark, sf_dir).collect()} and exact
