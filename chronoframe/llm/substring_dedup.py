"""Substring deduplication by relative Lempel-Ziv parsing against an index of reference blocks.

Every document is both text and reference. It is cut into reference blocks by its content: the windows of `window`
words that share one minimiser (the smallest hash of their 16-word grams) and follow each other form a block, so equal
passages give equal blocks wherever they stand. The index holds each block once, at the place where the document with
the smallest id has it. Where passages start or end inside a block, blocks of one minimiser differ; of those blocks the
index holds every window as well, again once each. So a window that a smaller document holds is always found, with a
place in the reference.

The parse is greedy: a document is read from left to right, and a factor takes in blocks and windows as long as the next
one continues it at the next place of the same reference document. At a factor's end the next window is looked up for
itself, so no window across a boundary is lost. Every factor spans `window` words or more; the words of the factors are
the duplicate spans. Blocks and windows are looked up by 128-bit hashes of their words; no pair of documents is formed.
A factor follows the smallest document that holds each window, so where another document holds a longer stretch, it is
given as several factors of the same words.

Defined results: null or empty text has no words and loses none; documents of fewer than `window` words lose
none; a passage repeated inside one document only is kept; of rows that repeat a doc_id each is parsed, and
none of them is its own reference; rows whose doc_id is null lose nothing and are no reference; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, rolling, rolling_min, saved, table, text_chunks, word_hashes

GRAM = 16
_C = np.uint64(0xA24BAED4963EE407)


def _blocks(texts: list[bytes], window: int) -> tuple[np.ndarray, ...] | None:
    """For each window of the rows: row, position, minimiser, hash; then the index of each block's first
    window and each block's hash. None if no row is long enough."""
    h, sizes = word_hashes(texts)
    if not (sizes >= window).any():
        return None
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)
    position = np.arange(len(h)) - np.repeat(ends - sizes, sizes)
    low = rolling_min(rolling(h, GRAM), window - GRAM + 1)
    whole = rolling(h, window)
    ok = (position + window <= sizes[row])[: len(low)]
    row, position, low, whole = row[: len(low)][ok], position[: len(low)][ok], low[ok], whole[ok]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(row)))
    offset = (np.arange(len(row)) - np.repeat(starts, counts)).astype(np.uint64)
    block = mix(np.add.reduceat(mix(whole + offset * _C), starts) + counts.astype(np.uint64))
    return row, position, low, whole, starts, counts, block


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})


def _with_text_id(docs: DataFrame) -> DataFrame:
    """text_id tells apart rows that repeat a doc_id with another text."""
    return docs.select("doc_id", F.hash("text").alias("text_id"), "text")


def duplicate_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, text_id, matches: array of (start, n, ref_doc, ref_start) - the windows starting at words start .. start+n-1
    stand in a document with a smaller id, from its word ref_start on. Documents without any are absent."""
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words or more")
    docs = _with_text_id(docs)

    def emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_id"))
            for first, texts in text_chunks(batch):
                if (found := _blocks(texts, window)) is not None:
                    row, position, low, _, starts, counts, block = found
                    yield _batch(doc_id=ids[first + row[starts]].astype(np.int64), text_id=tids[first + row[starts]], start=position[starts].astype(np.int32), n=counts.astype(np.int32), key=low[starts], block=block)

    blocks = saved(docs.where("doc_id is not null").mapInArrow(emit_blocks, "doc_id long, text_id int, start int, n int, key long, block long"), "blocks")
    place = F.min(F.struct("doc_id", "start")).alias("ref")
    match = ["doc_id", "text_id", "start", "n", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start")]
    index = saved(blocks.groupBy("key", "block").agg(place), "block-index")
    whole = blocks.join(index, ["key", "block"]).where("ref.doc_id < doc_id").select(*match)

    # factor boundaries: minimisers that stand in more than one block
    contested = index.groupBy("key").agg(F.count("*").alias("blocks")).where("blocks > 1").select("key")
    to_parse = index.join(contested, "key").groupBy(F.col("ref.doc_id").alias("doc_id")).agg(F.collect_list("block").alias("wanted"))

    def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_id"))
            wanted = batch.column("wanted")
            for first, texts in text_chunks(batch):
                if (found := _blocks(texts, window)) is not None:
                    row, position, low, whole, starts, counts, block = found
                    asked = wanted.slice(first, len(texts))
                    owner = np.repeat(np.arange(len(texts)), np.diff(asked.offsets.to_numpy()))
                    tag = lambda rows, b: mix(b ^ mix(rows.astype(np.uint64) + _C))  # noqa: E731  a block of one row
                    hit = np.isin(tag(row[starts], block), tag(owner, asked.flatten().to_numpy().view(np.uint64)))
                    take = np.repeat(hit, counts)
                    yield _batch(doc_id=ids[first + row[take]].astype(np.int64), text_id=tids[first + row[take]], start=position[take].astype(np.int32), a=whole[take], b=low[take])

    texts = docs.where("doc_id is not null").repartition("doc_id")
    windows = saved(texts.join(to_parse, "doc_id").select("doc_id", "text_id", "text", "wanted").mapInArrow(emit_windows, "doc_id long, text_id int, start int, a long, b long"), "windows")
    # written, so that the planner knows its size and may split or broadcast where a window is very common
    shared = windows.groupBy("a", "b").agg(place, F.max("doc_id").alias("last")).where("ref.doc_id < last").drop("last")
    edges = windows.join(saved(shared, "window-index"), ["a", "b"]).where("ref.doc_id < doc_id").withColumn("n", F.lit(1)).select(*match)
    return whole.union(edges).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("matches"))


def factors(matches: np.ndarray, window: int) -> np.ndarray:
    """Rows of (start, words, ref_doc, ref_start) from rows of (start, windows, ref_doc, ref_start): the greedy parse from left
    to right. A match joins the factor before it where it continues it in the text and in the reference."""
    matches = matches[np.argsort(matches[:, 0], kind="stable")]
    start, n, doc, at = matches.T
    goes_on = (start[1:] == start[:-1] + n[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + n[:-1])
    first = np.flatnonzero(np.append(True, ~goes_on))
    return np.column_stack([start[first], np.add.reduceat(n, first) + window - 1, doc[first], at[first]])


_FACTOR = pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the words that no factor covers, joined by one space; and factors: array of
    (start, n_words, ref_doc, ref_start), in text order."""
    spans = duplicate_spans(docs, window)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("factors", pa.list_(_FACTOR))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("matches")
            for first, texts in text_chunks(batch):
                n_words, n_removed, kept, parsed = [], [], [], []
                for i, text in enumerate(texts):
                    words, own = text.split(), found[first + i].values
                    n_words.append(len(words))
                    parse = np.zeros((0, 4), np.int64)
                    if own is not None and len(own):
                        parse = factors(np.column_stack([own.field(k).to_numpy().astype(np.int64) for k in range(4)]), window)
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, parse[:, 0], 1)
                        np.add.at(step, parse[:, 0] + parse[:, 1], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                    parsed.append([dict(zip(("start", "n_words", "ref_doc", "ref_start"), row, strict=True)) for row in parse.tolist()])
                ids = batch.column("doc_id").slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(parsed, schema.field("factors").type)], schema=schema)

    both = _with_text_id(docs).repartition("doc_id", "text_id").join(spans, ["doc_id", "text_id"], "left")
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "matches").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start long, n_words long, ref_doc long, ref_start long>>")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d)),
firsts AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
cov AS (SELECT doc_id, list(DISTINCT p) AS gone
        FROM (SELECT win.doc_id, unnest(generate_series(win.s, win.s + 49)) AS p FROM win JOIN firsts USING (h) WHERE lo < win.doc_id)
        GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce((SELECT string_agg(x, ' ' ORDER BY p) FROM (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS p) WHERE gone IS NULL OR NOT list_contains(gone, p)), '')) AS kept_sha256
FROM d LEFT JOIN cov USING (doc_id)
"""
