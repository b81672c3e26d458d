"""Secret scanning: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two order-1 character models are trained in Spark over all documents: one of random strings, from the values
that the fixed patterns find (the labelled positives), one of ordinary identifiers, from the other tokens of
TOKEN_CHARS or more characters (the labelled negatives). The model of random strings is mixed with uniform ones over
ALPHABETS, so that a few labelled values don't fix an alphabet; that of identifiers with itself over the token in lower
case and parted at signs, with numbers, and with repeated characters. Every token of TOKEN_CHARS or more characters that no
pattern covers is judged: it is a secret where its log-likelihood ratio exceeds the log odds of an ordinary token, as
counted in training, ODDS at least. The ratio grows with the token, so short ones need stranger characters. A token
with hyphens is judged without them, else by its pieces. The counts are two fixed tables of 67 x 67 cells, whatever the
input.

Defined results: null text is empty and has no spans; positions are code points, ends exclusive; every row gives
one row, repeated ones too; with no labelled positives the random model is uniform; a column named secrets is replaced
by scan_secrets; other extra columns are ignored, or kept by mask_secrets.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, table

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
#: Shortest token that the models learn from and judge. Hyphens may join its pieces, as in keys behind a prefix and in
#: base64url; dots part tokens, as in a JWT.
TOKEN_CHARS = 8
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}")
PIECE = re.compile(rf"[A-Za-z0-9+/_=]{{{TOKEN_CHARS},}}")
#: Characters of the uniform models of random strings, and the least odds of an ordinary token against a random one.
ALPHABETS = (
    "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.ascii_lowercase + string.digits,
    string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, ALPHABET.decode(),
)
ODDS = 1000
SIZE = len(ALPHABET) + 1
_CODE = np.full(256, SIZE - 1, np.int64)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(SIZE - 1)
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def _values(text: str, found: list[tuple[int, int, str]]) -> list[str]:
    """The secret values alone, without the name a value is assigned to."""
    return [ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b] for a, b, kind in found]


def _pairs(data: bytes) -> np.ndarray:
    code = _CODE[np.frombuffer(data, np.uint8)]
    return np.bincount(code[:-1] * SIZE + code[1:], minlength=SIZE * SIZE)


def ordinary_tokens(text: str, found: list[tuple[int, int, str]]) -> list[str]:
    """Tokens of TOKEN_CHARS or more characters that touch no span of a fixed pattern."""
    if not found:
        return TOKEN.findall(text)
    out, ends = [], iter([*found, (len(text), len(text), "")])
    at = 0
    for a, b, _ in ends:
        if a > at:
            out += TOKEN.findall(text, at, a)
        at = max(at, b)
    return out


def pair_counts(docs: DataFrame) -> DataFrame:
    """label (1: value of a fixed pattern, 0: any other token), pair, n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for part in sliced(batch):
                values, tokens = [], []
                for text in part.column("text").to_pylist():
                    found = base_spans(text or "")
                    values += _values(text, found) if found else ()
                    tokens += ordinary_tokens(text or "", found)
                totals[1] += _pairs(" ".join(["", *values, ""]).encode())
                totals[0] += _pairs(" ".join(["", *tokens, ""]).encode())
        for label, n in enumerate(totals):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"label": pa.array(np.full(len(used), label, np.int32)), "pair": pa.array(used.astype(np.int32)), "n": pa.array(n[used])})

    counted = docs.select("text").mapInArrow(count, "label int, pair int, n long")
    return counted.groupBy("label", "pair").agg(F.sum("n").alias("n"))


class Models(NamedTuple):
    """For each pair of characters its log probability under each part of both mixtures, the parts' log weights, how many of
    them are parts of the ordinary one, and the log odds of an ordinary token."""

    pairs: np.ndarray
    weights: np.ndarray
    ordinary: int
    odds: float

    def ratios(self, tokens: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each token, random to ordinary."""
        if not tokens:
            return np.zeros(0)
        code = _CODE[np.frombuffer(" ".join(["", *tokens]).encode(), np.uint8)]
        starts = np.flatnonzero(code == SIZE - 1)
        parts = np.add.reduceat(self.pairs[code[:-1] * SIZE + code[1:]], starts, axis=0) + self.weights
        return np.logaddexp.reduce(parts[:, self.ordinary :], axis=1) - np.logaddexp.reduce(parts[:, : self.ordinary], axis=1)


def fit_models(n: np.ndarray) -> Models:
    """From the counts of pairs of characters, ordinary and random."""
    p = []
    for label, k in ((0, 0.002 * n[0].sum() + 1), (1, 200.0)):
        # rare rows lean on single characters, those on a uniform model: random strings among the ordinary text
        # don't make rare characters look ordinary
        single = n[label].sum(axis=0)
        single = 0.95 * (single + 1) / (single + 1).sum() + 0.05 / SIZE
        p.append(np.log((n[label] + k * single) / (n[label].sum(axis=1, keepdims=True) + k)))
    character = np.frombuffer(ALPHABET + b" ", np.uint8)
    plain = _CODE[np.frombuffer((ALPHABET + b" ").lower(), np.uint8)]
    plain[np.isin(character, np.frombuffer(b"+/_=", np.uint8))] = SIZE - 1
    of = lambda here, inside, outside: np.tile(np.log(np.where(here, inside, outside)), (SIZE, 1))
    number = of(np.isin(character, np.frombuffer(string.digits.encode(), np.uint8)), 0.09, 0.1 / (SIZE - 11))
    repeat = np.log(np.where(np.eye(SIZE, dtype=bool), 0.9, 0.1 / (SIZE - 1)))
    ordinary = [(1.0, p[0]), (0.1, p[0][plain][:, plain]), (0.1, number), (0.01, repeat)]
    uniform = [(0.5 / len(ALPHABETS), of(np.isin(character, np.frombuffer(a.encode(), np.uint8)), 1 / len(a), 1e-6)) for a in ALPHABETS]
    weights, pairs = zip(*ordinary, (0.5, p[1]), *uniform, strict=True)
    table = np.stack(pairs, axis=-1)
    table[:, SIZE - 1] = 0  # the end of a token
    begun = n[:, SIZE - 1, : SIZE - 1].sum(axis=1) + 1
    return Models(table.reshape(SIZE * SIZE, -1), np.log(weights), len(ordinary), max(math.log(ODDS), math.log(begun[0] / begun[1])))


def train(docs: DataFrame) -> Models:
    n = np.zeros((2, SIZE, SIZE))
    for r in pair_counts(docs).collect():  # at most 2 * 67 * 67 rows
        n[r.label].flat[r.pair] = r.n
    return fit_models(n)


def find_secrets(text: str, models: Models) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, log-likelihood ratio), base spans first where starts are equal."""
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))

    def judge(spans: list[tuple[int, int]]) -> list[tuple[tuple[int, int], float]]:
        asked, tokens = [], []
        for a, b in spans:
            token = text[a:b].replace("-", "")
            k = bisect_left(starts, b)  # base spans that start before b; one of them may reach into the token
            if len(token) >= TOKEN_CHARS and not (k and reach[k - 1] > a):
                asked.append((a, b))
                tokens.append(token)
        return [(span, score) for span, score in zip(asked, models.ratios(tokens).tolist(), strict=True) if score > models.odds]

    whole = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if text[a - 1 : a] == "@":  # the host of an address
            continue
        if text[b : b + 1] == "@":  # the last piece is the name before it
            b = max(a, text.rfind("-", a, b))
        while a < b and text[a] == "-":
            a += 1
        while a < b and text[b - 1] == "-":
            b -= 1
        whole.append((a, b))
    found = judge(whole)
    # a token without its hyphens; where that is no secret as one, its pieces
    secret = {span for span, _ in found}
    found += judge([p.span() for a, b in whole if (a, b) not in secret and text.find("-", a, b) >= 0 for p in PIECE.finditer(text, a, b)])
    spans = [(a, b, kind, None) for a, b, kind in base] + [(a, b, "markov", score) for (a, b), score in found]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """The rows of docs with secrets: an array of (kind, start, end, score). models: from train(); of docs if not given."""
    models = models or train(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": s} for a, b, k, s in find_secrets(t or "", models)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "secrets"])

    docs = docs.drop("secrets")
    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("secrets", SPANS)]))


def mask_secrets(docs: DataFrame, models: Models | None = None, mask: str = "[secret]") -> DataFrame:
    """The rows of docs with every secret in text replaced, overlapping ones as one; n_chars, if there, follows."""
    models = models or train(docs)

    def cut(text: str | None) -> str | None:
        out, at = [], 0
        for a, b, _, _ in find_secrets(text or "", models):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    follows = "n_chars" in docs.columns and docs.schema["n_chars"].dataType in (T.LongType(), T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [cut(t) for t in old]
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
            if follows:
                at = batch.schema.get_field_index("n_chars")
                n = [k if a == b else len(b) for a, b, k in zip(old, new, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, "n_chars", pa.array(n, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scan_secrets(docs).select("doc_id", "secrets")
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"] != "markov")
    n = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), n("markov"))
