"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of normalised words (lower case, ASCII punctuation removed). A document leaks an item where
some stretch of it is within floor(RATE * n) word edits of the item's n words. Windows of the size of an item are
looked at where the document holds one of the item's pieces word for word and enough of its words around it: cut
into one piece more than the edits allowed, an item keeps one piece whole, so these tests lose nothing.
The Chakraborty-Goldenberg-Koucky random walk embeds those and the items into sequences three times as long, in
which a few edits cost a few positions; hashes of sampled positions, in TABLES tables, bring windows and items
together. Every candidate is verified with exact edit distance, so there are no false hits. Copies whose windows
differ by the full RATE are found with a recall of 0.9 or more, as the tests measure; closer ones with more.

Words stand for themselves by their hashes, so what is found for an item depends on no other item. The benchmark
goes to the tasks in blocks of about BLOCK_BYTES; documents are scanned once per block and never shuffled. Defined results: null or empty texts and items without words leak nothing; an item of fewer than
1 / RATE words must stand word for word; hits of repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, rolling, table, word_hashes

RATE = 0.2
TABLES, SAMPLES = 40, 4
#: Text of one block of items, which the driver reads and every task gets; windows, and words of them, embedded at once.
BLOCK_BYTES, WINDOWS, WINDOW_WORDS = 8_000_000, 20_000, 1_000_000
_PUNCTUATION = string.punctuation.encode()
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def cleaned(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(None, _PUNCTUATION)


def normalised(text: str | None) -> list[bytes]:
    return cleaned(text).split()


def word_symbols(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of the normalised words of each text."""
    hashes, counts = word_hashes([cleaned(t) for t in texts])
    return np.split(hashes.view(np.int64), np.cumsum(counts)[:-1]) if len(counts) else []


def most_edits(n: int) -> int:
    return int(RATE * n + 1e-9)


def embed_samples(symbols: np.ndarray, seed: int) -> np.ndarray:
    """A key per table for each row of symbols (hashes of equally many words, -1: none): the CGK walk of each table, read
    at its sampled positions. What a step does with a symbol is a hash of both."""
    rows, n = symbols.shape
    padded = np.concatenate([symbols, np.full((rows, 1), -2)], axis=1).astype(np.int64).view(np.uint64)
    rng = np.random.default_rng((seed, n))
    reads = np.zeros((TABLES, 3 * n), bool)
    for t in range(TABLES):
        reads[t, rng.choice(3 * n, size=min(3 * n, SAMPLES), replace=False)] = True
    salt = rng.integers(0, 2**63, (TABLES, 1), dtype=np.uint64)
    every, at = np.arange(rows), np.zeros((TABLES, rows), np.int64)
    keys = np.repeat(np.arange(TABLES, dtype=np.uint64)[:, None], rows, axis=1)
    for j in range(int(np.flatnonzero(reads.any(axis=0))[-1]) + 1):
        x = padded[every, at]
        some = reads[:, j]
        if some.any():
            keys[some] = mix(keys[some] * _STEP + x[some])
        at += (mix(x * _STEP + np.uint64(j) + salt) >> np.uint64(40)).astype(np.int64) & 1
        np.minimum(at, n, out=at)
    return keys


def edit_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where the first such stretch ends (bit-parallel)."""
    n = len(item)
    where: dict[int, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for j, y in enumerate(text, 1):
        eq = where.get(y, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right, left = down | (~(xh | up) & full), up & xh
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) & full, (left << 1) & full
        up, down = (left | (~(xv | right) & full)), right & xv
        if score < best:
            best, end = score, j
    return best, end


class Benchmark:
    """One block of items, ready to be matched."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 7):
        self.seed = seed
        self.items = [(i, ws.tolist()) for (i, _), ws in zip(items, word_symbols([t for _, t in items]), strict=True) if len(ws)]
        self.sizes: dict[int, list[int]] = {}
        for k, (_, ws) in enumerate(self.items):
            self.sizes.setdefault(len(ws), []).append(k)
        self.words = [frozenset(ws) for _, ws in self.items]
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for n, members in self.sizes.items():
            keys = embed_samples(np.array([self.items[k][1] for k in members]), seed)
            self.tables[n] = []
            for row in keys.tolist():
                held: dict[int, list[int]] = {}
                for key, k in zip(row, members, strict=True):
                    held.setdefault(key, []).append(k)
                self.tables[n].append(held)
            q = n // (most_edits(n) + 1)
            for k in members:
                grams = rolling(self._hashed(np.array(self.items[k][1])), q).tolist()
                for at in range(0, (most_edits(n) + 1) * q, q):
                    pieces.setdefault(q, {}).setdefault(grams[at], []).append((k, at))
        self.pieces = {q: (np.array(sorted(held), np.uint64), [held[g] for g in sorted(held)]) for q, held in pieces.items()}

    @staticmethod
    def _hashed(symbols: np.ndarray) -> np.ndarray:
        return mix((symbols.astype(np.int64) + 2).view(np.uint64) * _STEP)

    def windows(self, symbols: np.ndarray) -> set[tuple[int, int]]:
        """(size, start) of the windows that may be near an item; start -1: the document is shorter than the item."""
        found: set[tuple[int, int]] = set()
        hashed = self._hashed(symbols)
        for q, (grams, owners) in self.pieces.items():
            g = rolling(hashed, q)
            at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            for p in np.flatnonzero(grams[at] == g).tolist():
                for k, offset in owners[at[p]]:
                    n = len(self.items[k][1])
                    d, start = most_edits(n), p - offset
                    near = set(symbols[max(0, start - d) : start + n + d].tolist())
                    if len(self.words[k] & near) < len(self.words[k]) - d:
                        continue
                    if len(symbols) < n:
                        found.add((n, -1))
                    else:
                        found.update((n, min(max(0, x), len(symbols) - n)) for x in range(start - d, start + d + 1))
        return found

    def hits(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """Per document (item_id, distance, first word, end word) of the items it leaks. Windows of one size are embedded together."""
        asked: dict[int, list[tuple[int, int]]] = {}
        for i, symbols in enumerate(docs):
            for n, start in sorted(self.windows(symbols)):
                asked.setdefault(n, []).append((i, start))
        found: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in docs]
        for n, places in asked.items():
            pairs: set[tuple[int, int, int]] = set()
            step = max(1, min(WINDOWS, WINDOW_WORDS // n))
            for first in range(0, len(places), step):
                some = places[first : first + step]
                window = np.full((len(some), n), -1)
                for row, (i, start) in enumerate(some):
                    part = docs[i][max(0, start) :][:n]
                    window[row, : len(part)] = part
                for held, keys in zip(self.tables[n], embed_samples(window, self.seed).tolist(), strict=True):
                    for (i, start), key in zip(some, keys, strict=True):
                        if key in held:
                            pairs.update((i, k, max(0, start)) for k in held[key])
            d = most_edits(n)
            for i, k, start in sorted(pairs):
                item_id, words = self.items[k]
                if k in found[i] and found[i][k][1] == 0:
                    continue
                low = max(0, start - d)
                distance, end = edit_match(words, docs[i][low : start + n + d].tolist())
                if distance <= d and (k not in found[i] or distance < found[i][k][1]):
                    _, length = edit_match(words[::-1], docs[i][low : low + end][::-1].tolist())
                    found[i][k] = (item_id, distance, low + end - length, low + end)
        return [sorted(f.values()) for f in found]

    def leaks(self, texts: pa.Array) -> Iterator[list[tuple[int, int, int, int]]]:
        for k in range(0, len(texts), 2000):
            yield from self.hits(word_symbols(texts.slice(k, 2000).to_pylist()))


def _blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    items = benchmark.select("item_id", "text").where("item_id is not null").distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        if rows := part.collect():  # about BLOCK_BYTES
            yield Benchmark(sorted((r[0], r[1] or "") for r in rows))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word: one row per document and item it leaks, at its nearest stretch."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64())])

    def scan(block: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc_id, hits in zip(batch.column("doc_id").to_pylist(), block.leaks(batch.column("text")), strict=True):
                    out += [dict(zip(schema.names, (doc_id, *hit), strict=True)) for hit in hits]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

        return run

    docs, found = docs.select("doc_id", "text"), None
    for block in _blocks(benchmark):
        hits = docs.mapInArrow(scan(block), "doc_id long, item_id long, distance int, start_word long, end_word long")
        found = hits if found is None else found.union(hits)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, start_word long, end_word long") if found is None else found


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item."""
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_without(block), docs.schema)
    return docs


def _without(block: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not hits for hits in block.leaks(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
