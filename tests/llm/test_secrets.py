import hashlib
import random
import re
import string

import numpy as np

from chronoframe.llm.entries import QUERIES
from chronoframe.llm.secrets import SIZE, _pairs, base_spans, find_secrets, fit_models, mask_secrets, scan_secrets, train


def naive(text):
    """The contract read word for word: leftmost non-overlapping matches of each kind, those that fail dropped."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_base_patterns():
    rng = random.Random(3)
    parts = ["token", "Password", "api_key", "APIKEY", "secret", "=", " = ", ":", '"', "'", " ", "AKIA", "AKIAABCD", "é", "ſecret=abcdefghij", "toKen=abcdefghij", "0123456789abcdef", "deadbeef" * 4, "short", "ABCD1234EFGH", "\n", "x/y+z=.-_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == naive(text), text


def test_models_find_random_strings_only(spark):
    rng = random.Random(4)
    syllables = ["the", "an", "er", "tion", "lich", "queue", "ing", "ha", "ré"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    alnum = string.ascii_letters + string.digits
    key = lambda n: "".join(rng.choice(alnum) for _ in range(n))
    rows, truth = [], {}
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words[10] = f'token = "{key(40)}"'
        if i % 5 == 0:
            truth[i] = words[20] = key(32) + "7a"
        if i % 7 == 0:
            words[30] = "thetheration_erlichingtion_2024_erration"
        words[40] = "anna.33@mail4.example.com 4929348385146306 233.254.104.120"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (901, "")], "doc_id long, text string").withColumn("secrets", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    text = dict(rows)
    got = {r.doc_id: r.secrets for r in scan_secrets(df).collect()}
    caught = {i: [text[i][s.start : s.end] for s in got[i] if s.kind == "markov"] for i in text}
    assert sum(caught[i] == [truth[i]] for i in truth) >= 0.95 * len(truth)
    assert not any(caught[i] for i in text if i not in truth)
    assert got[900] == [] and got[901] == []
    for r in mask_secrets(df.select("doc_id", "text")).collect():
        assert not base_spans(r.text or "") and (r.text is None) == (r.doc_id == 900)


def test_keys_with_hyphens_and_dots(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) + "7a"
    plain = "the other thing-of-the-night was an-in-the-erlich 2024 and a tion-ing-er-the-an-er-tion-2024-the-other there. "
    rows = [(i, plain * 9 + f'token = "{key(40)}" ') for i in range(400)]
    shapes = [lambda: "sk-" + key(40), lambda: "-".join(key(9) for _ in range(4)), lambda: ".".join(key(30) for _ in range(3)), lambda: f"{key(25)}-{key(10)}.{key(6)}-{key(26)}", lambda: key(40)]
    secrets = [make() for make in shapes]
    rows += [(1000 + i, f"{plain}{s} {plain}{s}-, {s}. ({s})") for i, s in enumerate(secrets)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in mask_secrets(df).collect()}
    for i, s in enumerate(secrets):
        assert not any(p in got[1000 + i] for p in re.split(r"[.-]", s) if len(p) > 4), (s, got[1000 + i])
        assert got[1000 + i].count(plain.strip()) == 2
    ratio = train(df)
    slug = "the-other-thing-of-the-night-of-an-erlich-ing-and-the-other-night-2024-"
    long = key(38)
    found = find_secrets(f"{slug * 3}{long}", ratio)
    assert [(f"{slug * 3}{long}"[a:b], k) for a, b, k, _ in found] == [(long, "markov")]
    assert find_secrets(f"x@mail.org y-z@{key(30)} {slug * 3}the", ratio) == []


def test_held_out_tokens_by_length():
    """Models of half the tokens, asked about the other half: recall and false alarms per length."""
    rng = random.Random(6)
    syllables = ["the", "an", "er", "tion", "lich", "queue", "ing", "ha", "con", "sta", "do", "mi", "ver", "pro"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(3, 7)))
    shapes = [word, lambda: word().title(), lambda: word().upper(), lambda: f"{word()}_{word()}", lambda: f"/{word()}/{word()}", lambda: str(rng.randrange(10**9, 10**16)), lambda: "=" * rng.randint(8, 40)]
    ordinary = [t for t in (rng.choices(shapes, (40, 5, 1, 1, 1, 1, 1))[0]() for _ in range(40000)) if len(t) >= 8]
    labelled = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    count = lambda tokens: sum(_pairs(" ".join(["", *tokens[k : k + 1000], ""]).encode()) for k in range(0, len(tokens), 1000)).reshape(SIZE, SIZE)
    models = fit_models(np.stack([count(ordinary[::2]), count(labelled[::2])]).astype(float))
    false = models.ratios(ordinary[1::2]) > models.odds
    lengths = np.array([len(t) for t in ordinary[1::2]])
    assert false.mean() < 2e-4 and all(false[(lengths >= a) & (lengths < b)].mean() < 2e-3 for a, b in ((8, 12), (12, 16), (16, 20), (20, 99)))
    assert (models.ratios(labelled[1::2]) > models.odds).all()
    for alphabet in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits, "0123456789abcdef"):
        for n, least in ((8, 0.4), (12, 0.7), (15, 0.8), (20, 0.95), (28, 0.99), (40, 0.99)):
            keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(400)]
            assert (models.ratios(keys) > models.odds).mean() >= least, (alphabet, n)


def test_no_labelled_values(spark):
    df = spark.createDataFrame([(1, "only plain words here")], "doc_id long, text string")
    assert find_secrets("only plain words here", train(df)) == []
    assert scan_secrets(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op2_secrets"](spark, sf_dir).collect():
        want = naive(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[2] == k for w in want) for k in ("assign", "access", "hex"))
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
