import math
import os
import re
from collections import Counter, defaultdict

import corpus_pipeline
from chronoframe.llm import common
from chronoframe.llm import decontaminate as dc
from chronoframe.llm.toxicity import INTENTS, NEGATIONS, PATTERNS, REPORTS, TARGETS, THREATS, trained_on
from tests.llm.test_ngram_join import brute
from tests.llm.test_secrets import naive as base_spans
from tests.llm.test_toxicity import naive as paths


def is_toxic(text, lexicon, weights):
    """The grammar by its definitions: each clause cut out, each word given its symbol, each match looked at for itself."""
    small = {w: s for s, ws in (("W", INTENTS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws}
    found = Counter()
    for clause in re.split(r"[.!?;:\n\r]", text.lower()):
        symbols = ""
        for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause):
            insult = any(w == s[:-1] if s.endswith("$") else w.startswith(s) for s in lexicon)
            symbols += "I" if insult else "H" if w in THREATS else small.get(w) or small.get(w.replace("’", "'"), "O")
        found.update(paths(symbols))
    z = weights[0] + sum(w * math.log2(1 + found[p]) for p, w in zip(PATTERNS, weights[1:], strict=True))
    return 1 / (1 + math.exp(-z)) >= 0.7


def targets(sizes):
    """Water filling by plain steps: shares by weight, no source above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest, share = total - sum(full.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / share > 3 * sizes[s] + 1e-9]
        if not over:
            return full | {s: rest * weight[s] / share for s in left}
        full |= {s: 3 * sizes[s] for s in over}


def test_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [[w.decode() for w in dc.normalised(r.text)] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    lexicon, weights = trained_on(spark, sf_dir)
    clean = [i for i, r in docs.items() if not is_toxic(r.text or "", lexicon, weights)]
    kept = [i for i, _, c in brute([(i, docs[i].text) for i in clean]) if i == c]

    def leak(text):
        words = [w.decode() for w in dc.normalised(text)]
        return min((dc.edit_match(item, words)[0] / len(item) for item in items if item), default=1)

    near = {i: leak(docs[i].text) for i in kept}
    there = set(os.listdir(common.shared_dir(spark)))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = {r.doc_id: r for r in rows}
    left = {re.sub(r"-[0-9a-f]{32}$", "", name) for name in set(os.listdir(common.shared_dir(spark))) - there}
    assert left == {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES}
    assert len(rows) == len(got) and set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "copies"}
    # what the mix leaves out is a matter of its draw, so the stages before it are looked at by themselves
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        before = stage(spark, before, sf_dir)
    before = {r.doc_id: r for r in before.collect()}
    leaking = {i for i in kept if near[i] <= dc.RATE}
    assert set(before) >= set(kept) - leaking and len(set(before) & leaking) <= 0.1 * len(leaking) and set(before) <= set(kept)
    assert not any(near[i] == 0 for i in before)
    for i, r in before.items():
        masked, at = [], 0
        for a, b, _ in base_spans(docs[i].text):
            if a >= at:
                masked += [docs[i].text[at:a], "[secret]"]
            at = max(at, b)
        want = "".join([*masked, docs[i].text[at:]])
        assert r.text == want and r.n_chars == len(want), i
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before.values():
        sizes[r.source] += len(r.text.split())
    for i, r in got.items():
        assert 1 <= r.copies <= 3 and r.text == before[i].text
        taken[r.source] += r.copies * len(r.text.split())
    for source, target in targets(sizes).items():
        longest = max(len(r.text.split()) for r in before.values() if r.source == source)
        assert abs(taken[source] - target) <= longest, source


ODD = [
    (1, "a b c d e f g", "en", "x", 13, 1, 5, 9, "s"), (1, "a b c d e f g", "en", "x", 13, 2, 5, 9, "s"), (1, "other text of the same id here", "en", "x", 30, 3, 5, 9, "s"),
    (None, None, None, None, None, 4, None, None, None), (None, "no id but words enough to stay", None, None, 30, 5, None, None, None), (7, "", "de", "", 0, 6, 1, 1, ""),
    (8, "word " * 60_000, "en", "x", 300_000, 7, 1, 1, ""), (9, "you idiot, you moron", "en", "y", 20, 8, 1, 1, ""), (10, 'password = "abcdefgh12"', "en", "y", 23, 9, 1, 1, ""),
]


def test_stages_with_nulls_repeats_and_clashing_names(spark, sf_dir):
    """Columns named like those the stages make inside: they come out as they went in."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, `from` int, toxicity int, id int, secrets string")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        out[name] = sorted((r["from"] for r in got.collect()))
        for r in got.collect():
            was = ODD[r["from"] - 1]
            assert (r.toxicity, r.id, r.secrets, r.lang) == (was[6], was[7], was[8], was[2])
    assert out["toxicity"] == [1, 2, 3, 4, 5, 6, 7, 9] and out["decontamination"] == list(range(1, 10)) == out["secrets"]
    assert len(out["near copies"]) == 7 and {4, 5, 6, 7, 8, 9} <= set(out["near copies"])  # one row of id 1
    mixed = corpus_pipeline.mixing(spark, docs.withColumn("copies", docs.id).withColumn("mix1", docs.id), sf_dir)
    assert mixed.columns == [*docs.columns, "mix1", "copies"]
    rows = mixed.collect()
    assert len({r["from"] for r in rows}) == len(rows) and all(1 <= r.copies <= 3 for r in rows)


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "secrets", "mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_mixing_rows_of_one_id(spark, tmp_path):
    """Rows that repeat an id, a size, a text or all of these have their own copies: each source keeps its target."""
    rows = [(i // 2 if i % 9 else None, "w " * (3 + i % 2 * (i % 7 + 1)), "ab"[i // 2 % 2], i) for i in range(200)]
    rows += [(None, "same five words of text", "c", 1000 + i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, i int").repartition(4)
    size = {i: len(t.split()) for _, t, _, i in rows}
    of = {i: s for _, _, s, i in rows}
    target = {r.source: r.target for r in corpus_pipeline.mix_sources(docs).collect()}
    docs.write.parquet(str(tmp_path / "docs"))
    for d in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        got = {r.i: r.copies for r in corpus_pipeline.mixing(spark, d, "").collect()}
        again = corpus_pipeline.mixing(spark, d, "").collect()
        assert len(again) == len(got) and all(1 <= c <= 3 for c in got.values())
        for source in "abc":
            taken = sum(size[i] * c for i, c in got.items() if of[i] == source)
            assert abs(taken - target[source]) <= max(size.values()), (source, taken, target)
        read = corpus_pipeline.mixing(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
        assert sorted((r.i, r.copies) for r in read) == sorted((r.i, r.copies) for r in corpus_pipeline.mixing(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect())
