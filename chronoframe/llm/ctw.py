"""Language-model scoring by context-tree weighting over bytes, beside a unigram word score.

A byte is eight binary decisions; each decision has a context tree over the bytes before it, of depth `DEPTH`.
Every node estimates the next bit by Krichevsky-Trofimov from its counts, and a text's probability mixes the
estimates of all depths on its path with the weights that context-tree weighting gives them after training.
A context that training never met takes the estimate of the deepest one it did meet.

The model is never broadcast: documents are dealt into buckets of bounded text, each bucket says which words and
byte runs it holds, counts are summed over all training documents in Spark, and each bucket gets back the values
of its own words and runs. Tree nodes of depth 2 and more are worked out where the runs are, dealt by their last
two context bytes; only the nodes of depth 1 (65,280 at most) pass through the driver.

Defined results: null text is empty; an empty text has the one token that ends every text; a row whose doc_id is
null counts as id ''; every row gives one row, repeated ones too, wherever they are dealt; a NUL byte is the symbol that
ends a text; without training documents all counts are 0;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, saved, table, with_place

DEPTH = 4
#: Bytes of text of one bucket, and of one step inside a task.
BUCKET_BYTES, STEP_BYTES = 16_000_000, 2_000_000
_PAD = b"\0" * DEPTH
_FEATURE = "bucket int, token binary, run long, n long"


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def run_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the DEPTH context bytes and the byte of every byte of the texts and of the end of each; where each text starts."""
    a = np.frombuffer(_PAD + _PAD.join(texts) + _PAD, np.uint8)
    code = np.zeros(len(a) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        code <<= 8
        code |= a[k : len(a) - DEPTH + k]
    sizes = np.array([len(t) for t in texts])
    keep = np.ones(len(code), bool)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    for k in range(1, DEPTH):  # the rest of the padding between texts
        at = starts + sizes + k
        keep[at[at < len(code)]] = False
    return code[keep], np.cumsum(sizes + 1) - sizes - 1


def _steps(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, now, n = 0, [], 0
    for i, t in enumerate(texts):
        now.append(t)
        n += len(t)
        if n >= STEP_BYTES:
            yield first, now
            first, now, n = i + 1, [], 0
    if now:
        yield first, now


def _features(group: pa.Table) -> pa.Table:
    """The words and byte runs of one bucket, with their counts in its training documents."""
    bucket = group.column("bucket")[0].as_py()
    texts, out = as_bytes(group.column("text").combine_chunks()), group.column("held_out").to_pylist()
    words, seen, runs = Counter(), set(), []
    for train in (True, False):
        some = [t for t, o in zip(texts, out, strict=True) if o != train]
        for _, step in _steps(some):
            for t in step:
                if train:
                    words.update(t.lower().split())
                else:
                    seen.update(t.lower().split())
            counted = pc.value_counts(pa.array(run_codes(step)[0]))
            n = counted.field("counts").to_numpy()
            runs.append((counted.field("values").to_numpy(), n if train else n * 0))
        if train and some:
            words[b""] = len(some)
    words.update(dict.fromkeys(seen - words.keys(), 0))
    words.setdefault(b"", 0)
    code, at = np.unique(np.concatenate([r[0] for r in runs]), return_inverse=True)
    n = np.bincount(at, np.concatenate([r[1] for r in runs])).astype(np.int64)
    total = len(words) + len(code)
    return pa.table({
        "bucket": pa.array(np.full(total, bucket, np.int32)),
        "token": pa.chunked_array([pa.array(list(words), pa.binary()), pa.nulls(len(code), pa.binary())]).combine_chunks(),
        "run": pa.chunked_array([pa.nulls(len(words), pa.int64()), pa.array(code)]).combine_chunks(),
        "n": pa.array(np.concatenate([np.fromiter(words.values(), np.int64, len(words)), n])),
    })


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for _ in range(8):
        shift += np.log(x)
        x = x + 1
    i = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + i / 12 - i**3 / 360 + i**5 / 1260 - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


class Nodes:
    """Nodes of one depth, sorted by key: context bytes, the last one lowest, then the prefix of the symbol's bits."""

    def __init__(self, key, n0, n1, children=None):
        self.key, self.n0, self.n1 = key, n0, n1
        self.kt = log_kt(n0, n1)
        self.weighted = self.kt if children is None else np.logaddexp(self.kt, children) - math.log(2)
        self.own = np.ones(len(key)) if children is None else np.exp(self.kt - self.weighted) / 2

    def up(self, depth: int) -> Nodes:
        """The nodes one byte of context less deep."""
        key, at = np.unique(self.key & ((1 << 8 * depth) - 1), return_inverse=True)
        return Nodes(key, *(np.bincount(at, v, len(key)) for v in (self.n0, self.n1, self.weighted)))

    def path(self, above: tuple[np.ndarray, ...] | None, depth: int) -> tuple[np.ndarray, ...]:
        """For each node: what the depths so far add to P(1), the weight that is left, the last estimate met."""
        n = self.n0 + self.n1
        if above is None:
            done, left, last = np.zeros(len(n)), np.ones(len(n)), np.full(len(n), 0.5)
        else:
            at = np.searchsorted(above[0], self.key & ((1 << 8 * depth) - 1))
            done, left, last = (v[at] for v in above[1:])
        last = np.where(n > 0, (self.n1 + 0.5) / (n + 1), last)
        own = np.where(n > 0, self.own, 0.0)
        return self.key, done + left * own * last, left * (1 - own), last


def leaves(run: np.ndarray, n: np.ndarray) -> Nodes:
    symbol, context = run & 255, run >> 8
    keys, ones = [], []
    for j in range(8):
        keys.append(context << 8 | (1 << j) | symbol >> (8 - j))
        ones.append(symbol >> (7 - j) & 1)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    one, n = np.concatenate(ones), np.tile(n, 8)
    return Nodes(key, np.bincount(at, n * (1 - one), len(key)), np.bincount(at, n * one, len(key)))


def _deep(run: np.ndarray, n: np.ndarray) -> list[Nodes]:
    """Nodes of depth DEPTH, .., 2."""
    levels = [leaves(run, n)]
    for depth in range(DEPTH, 2, -1):
        levels.append(levels[-1].up(depth))
    return levels


def log2_of_runs(run: np.ndarray, n: np.ndarray, top: tuple[np.ndarray, ...]) -> np.ndarray:
    """log2 P(byte | context) of each run; top: path() of the nodes of depth 1."""
    levels = _deep(run, n)
    path = top
    for depth, nodes in zip(range(2, DEPTH + 1), reversed(levels), strict=True):
        path = nodes.path(path, depth)
    key, done, left, last = path
    one = done + left * last
    symbol, context = run & 255, run >> 8
    total = np.zeros(len(run))
    for j in range(8):
        p = one[np.searchsorted(key, context << 8 | (1 << j) | symbol >> (8 - j))]
        total += np.log2(np.where(symbol >> (7 - j) & 1, p, 1 - p))
    return total


def top_paths(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, ...]:
    """path() of the nodes of depth 1, from their sorted keys, counts and the summed weights of their children."""
    one = Nodes(key, n0, n1, children)
    return one.path(one.up(1).path(None, 0), 1)


def run_probabilities(runs: DataFrame) -> DataFrame:
    """run, log2p from run, n: context-tree weighting over all counts."""
    runs = saved(runs, "runs")
    dealt = runs.repartition(F.shiftright("run", 8) % 65536)

    def read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(b.column("run").to_numpy(), b.column("n").to_numpy().astype(float)) for b in batches if b.num_rows]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))

    def shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, n = read(batches)
        if len(run):
            low = _deep(run, n)[-1]
            yield pa.RecordBatch.from_pydict({"key": low.key & 0xFFFF, "n0": low.n0, "n1": low.n1, "children": low.weighted})

    level = dealt.mapInArrow(shallow, "key long, n0 double, n1 double, children double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "children")))
    rows = sorted(tuple(r) for r in level.collect())  # 256 contexts * 255 bit prefixes at most
    top = top_paths(np.array([r[0] for r in rows], np.int64), *(np.array([r[k] for r in rows], float) for k in (1, 2, 3)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, n = read(batches)
        if len(run):
            yield pa.RecordBatch.from_pydict({"run": run, "log2p": log2_of_runs(run, n, top)})

    return dealt.mapInArrow(score, "run long, log2p double")


def _score(total: int, distinct: int):
    norm = math.log10(total + 0.5 * (distinct + 1))

    def run(group: pa.Table, values: pa.Table) -> pa.Table:
        texts = as_bytes(group.column("text").combine_chunks())
        words = values.filter(pc.is_valid(values.column("token")))
        count = dict(zip(words.column("token").to_pylist(), words.column("value").to_pylist(), strict=True))
        log = {w: math.log10(c + 0.5) for w, c in count.items()}
        runs = values.filter(pc.is_valid(values.column("run")))
        order = np.argsort(code := runs.column("run").to_numpy())
        code, log2p = code[order], runs.column("value").to_numpy()[order]
        n_tokens, n_known, base, score, n_bytes = [], [], [], [], []
        for _, step in _steps(texts):
            for t in step:
                w = t.lower().split()
                w.append(b"")
                n_tokens.append(len(w))
                base.append(sum(map(log.__getitem__, w)) - len(w) * norm)
                n_known.append(sum(1 for x in map(count.__getitem__, w) if x))
                n_bytes.append(len(t))
            codes, starts = run_codes(step)
            found = pa.array(codes).dictionary_encode()
            at = np.searchsorted(code, found.dictionary.to_numpy())
            score += np.add.reduceat(log2p[at][found.indices.to_numpy()], starts).tolist()
        score = np.array(score) * math.log10(2)
        return pa.table({
            "doc_id": group.column("doc_id"), "held_out": group.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array(np.full(len(texts), total, np.int64)), "base_score": pa.array(base, pa.float64()), "score": pa.array(score),
            "bits_per_byte": pa.array(-score / math.log10(2) / (np.array(n_bytes) + 1)),
        })

    return run


def deal(docs: DataFrame, out: Column) -> DataFrame:
    """doc_id, text, held_out, bucket: rows dealt into buckets of about BUCKET_BYTES by their place, equal rows too."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), out.alias("held_out"))
    docs, place = with_place(docs, "unscored")
    size = docs.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 1
    buckets = -(-size // BUCKET_BYTES)
    return docs.select("*", F.pmod(place, F.lit(buckets)).cast("int").alias("bucket")).repartition(int(buckets), "bucket")


def score_texts(docs: DataFrame, out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; out: True for documents that don't train."""
    dealt = deal(docs, out)
    features = saved(dealt.groupBy("bucket").applyInArrow(_features, _FEATURE), "features")
    words, runs = features.where("token is not null"), features.where("run is not null")
    counts = saved(words.groupBy("token").agg(F.sum("n").alias("value")), "words")
    total, distinct = counts.where("value > 0").agg(F.coalesce(F.sum("value"), F.lit(0)), F.count("*")).first()
    log2p = saved(run_probabilities(runs.groupBy("run").agg(F.sum("n").alias("n"))), "log2p")
    none = lambda kind: F.lit(None).cast(kind)
    back = words.join(counts, "token").select("bucket", "token", none("long").alias("run"), F.col("value").cast("double").alias("value"))
    back = back.union(runs.join(log2p, "run").select("bucket", none("binary").alias("token"), "run", F.col("log2p").alias("value")))
    schema = f"doc_id {dealt.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(_score(int(total), int(distinct)), schema)


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
