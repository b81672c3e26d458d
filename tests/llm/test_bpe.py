import hashlib
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from chronoframe.llm.bpe import Vocabulary, decode, digests, encode  # noqa: E402
from chronoframe.llm.entries import QUERIES  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return Vocabulary(PATH).coder()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def plain_bpe(v, piece):
    """Merge the pair learned first, leftmost first, until none is left."""
    parts = [v.tokens[bytes([b])] for b in piece]
    while len(parts) > 1:
        ranks = [v.across.get(a * v.n + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        if (low := min(ranks)) == 1 << 40:
            break
        k = ranks.index(low)
        whole = bytes(v.bytes[v.offsets[parts[k]] : v.offsets[parts[k] + 1]]) + bytes(v.bytes[v.offsets[parts[k + 1]] : v.offsets[parts[k + 1] + 1]])
        parts[k : k + 2] = [v.tokens[whole]]
    return parts


def test_backtracking_is_plain_merging(coder):
    rng = random.Random(3)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))).encode() for letters in ("ab", "etaoinshr", "aàé日 ", "0123x", "'\"-=") for _ in range(300)]
    for piece in [*pieces, b"a" * 999, bytes(range(256))]:
        assert coder.tokens_of(piece) == plain_bpe(coder.v, piece), piece


def test_texts_as_the_library(coder, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab é\n\t ½²Ⅷ_'s1　\x1c\x85日本é🙂") for _ in range(rng.randrange(60))) for _ in range(1000)]
    texts += ["", " ", "a" * 5000, "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>", "  <|endoftext|", "\x00\x01", "".join(chr(rng.randrange(32, 0x3000)) for _ in range(3000)), "x" * 200_000 + " \n" * 1000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert coder.decode(ids) == text == library.decode(want.ids, skip_special_tokens=False)


def test_characters_are_classed_as_in_the_library(coder, library):
    """Every code point that the fast pattern is trusted with, beside a letter, a digit and a mark."""
    cps = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not coder.odd[c] and unicodedata.category(chr(c)) not in ("Co",)]
    for before in "a1!":
        text = "\n".join(before + chr(c) for c in cps)
        got, at = set(), 0
        for piece in coder.pieces.findall(text):
            at += len(piece)
            got.add(at)
        want = {end for _, (_, end) in library.pre_tokenizer.pre_tokenize_str(text)}
        assert got == want


def test_cut_tokens_that_decode_to_no_text(coder, library):
    for ids in ([], [50256, 0], [162], [162, 95], [17312, 162]):
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "a b", "x"), (2, "", None), (2, "", None), (3, "word " * 50_000, "y"), (4, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(digests(docs, PATH).collect(), key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2):
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty)
    assert {r.ids_sha256 for r in got if r.doc_id in (None, 4)} == {hashlib.sha256(np.array([64, 275], "<u4").tobytes()).hexdigest()}
    back = decode(encode(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text is None
    assert digests(docs.where("false"), PATH).count() == 0


def test_query_as_the_library(spark, sf_dir, library):
    got = {r.doc_id: r for r in QUERIES["op13_bpe"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(rows)
    for row, want in zip(rows, library.encode_batch([r.text for r in rows], add_special_tokens=False), strict=True):
        r = got[row.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(want.ids), hashlib.sha256(np.array(want.ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want.ids, skip_special_tokens=False).encode()).hexdigest()
