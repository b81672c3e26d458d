"""Exact ranked search by inner products over sparse ball trees.

Every document is indexed once: its terms (as 64-bit hashes) with their counts, a row each. Queries come in blocks of
bounded size; for a block the index is read again, projected on the block's terms, which alone add to its scores, and
each task puts its rows into ball trees of bounded size. A node knows the centroid and radius of the documents below
it, and of each term the highest value. A query's score there is at most the product with the centroid plus radius
times the norm of the query over the terms that occur below the node, and at most the product with the highest
values. Bounds are doubles, raised by far more than their rounding. Subtrees are visited best bound first, until the
best one left is below the k-th score so far; leaves are scored in integers. A task hands on k rows for each query.

Scores: N documents with terms, L terms in all, n and tf counts in a document, df documents of a term,
m = 10 + (90 * n * N) div L, a term's weight w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a document scores the sum
of w * ((1000000000 * tf) div (1000 * tf + 8 * m)) over the distinct terms of the query.

Defined results: a null or empty text has no terms: as a document it counts nowhere, as an item it finds nothing. Rows
that repeat a doc_id or an item_id are documents or items of their own; a null doc_id ranks after others of its score;
items of equal texts are searched once. Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, new_path, saved, table, text_chunks, word_hashes

#: Bytes of query texts searched at once; documents below a leaf; terms of documents in a tree.
BLOCK_BYTES, LEAF, TREE_TERMS = 1 << 22, 24, 1 << 20
#: By how much bounds are raised: far above the rounding of sums of doubles.
RAISED = 1e-9
#: ASCII capitals are lower-cased, other ASCII characters than letters and digits part terms.
_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts as signed integers, and the number of terms of each text."""
    h, counts = word_hashes([t.translate(_TERM) for t in texts])
    return h.view(np.int64), counts


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_chunks(batch):
            h, counts = term_hashes(texts)
            ends = np.cumsum(counts)
            found = [np.unique(h[e - c : e], return_counts=True) for e, c in zip(ends, counts, strict=True)]
            offsets = pa.array(np.cumsum([0, *(len(t) for t, _ in found)]), pa.int32())
            terms, tf = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            ids = batch.column("doc_id").slice(first, len(texts))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n": pa.array(counts, pa.int64()), "terms": pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int64())), "tf": pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))})


def index_terms(docs: DataFrame) -> DataFrame:
    """doc_id, n, terms, tf: the distinct terms of every document, and how often they occur."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_indexed, f"doc_id {kind}, n long, terms array<long>, tf array<long>")


class Queries:
    """A block of queries: their keys, and for each the places of its distinct terms in the block's sorted vocabulary."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.keys = [key for key, _ in rows]
        h, counts = term_hashes([text.encode() for _, text in rows])
        self.vocabulary, places = np.unique(h, return_inverse=True)
        self.terms = [np.unique(p) for p in np.split(places, np.cumsum(counts)[:-1])]

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are in the vocabulary, and their places there."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == terms)
        return known, at[known]

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)


def query_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """Texts (key, text) in blocks of about block_bytes."""
    n = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    for k in range(n):
        part = texts.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k) if n > 1 else texts
        if (rows := part.collect()) and len((block := Queries(sorted(map(tuple, rows)))).vocabulary):  # about block_bytes
            yield block


class BallTree:
    """A ball tree over sparse rows, given as CSR: start of each row (and the end), columns and integer values."""

    def __init__(self, start: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF):
        self.width, n = width, len(start) - 1
        order, norms = np.arange(n), np.add.reduceat(np.square(values.astype(float)), start[:-1])
        self.low, self.high, self.left, self.radius = [0], [n], [-1], []
        nodes, terms, middle, peak = [], [], [], []
        at = 0
        while at < len(self.low):  # children are numbered after their parents
            low, high = self.low[at], self.high[at]
            rows = order[low:high]
            size = start[rows + 1] - start[rows]
            ends = np.cumsum(size)
            own = np.arange(ends[-1]) + np.repeat(start[rows] - ends + size, size)
            column, value, first = columns[own], values[own].astype(float), ends - size
            total = np.bincount(column, value, width)
            top = np.zeros(width)
            np.maximum.at(top, column, value)
            centroid, support = total / len(rows), np.flatnonzero(top)
            nodes.append(np.full(len(support), at))
            terms.append(support)
            middle.append(centroid[support])
            peak.append(top[support])

            def far(point: np.ndarray) -> np.ndarray:
                """Squared distances of the rows to a point."""
                return np.maximum(norms[rows] - 2 * np.add.reduceat(value * point[column], first) + point @ point, 0)  # noqa: B023

            away = far(centroid)
            # the difference of large squares may be off by their rounding
            self.radius.append(math.sqrt(away.max() + RAISED * (norms[rows].max() + centroid @ centroid)) * (1 + RAISED))
            if len(rows) > leaf and away.max() > RAISED * norms[rows].max():
                one, other = np.zeros(width), np.zeros(width)
                k = away.argmax()
                one[column[first[k] : ends[k]]] = value[first[k] : ends[k]]
                from_one = far(one)
                k = from_one.argmax()
                other[column[first[k] : ends[k]]] = value[first[k] : ends[k]]
                side = from_one - far(other)
                right = side > 0
                if min(right.sum(), len(rows) - right.sum()) * 16 < len(rows):  # keeps the tree shallow
                    right = np.zeros(len(rows), bool)
                    right[np.argsort(side, kind="stable")[len(rows) // 2 :]] = True
                order[low:high] = np.concatenate([rows[~right], rows[right]])
                self.left[at] = len(self.low)
                cut = high - int(right.sum())
                self.low += [low, cut]
                self.high += [cut, high]
                self.left += [-1, -1]
            at += 1
        self.radius = np.array(self.radius)
        terms = np.concatenate(terms)
        by_term = np.argsort(terms, kind="stable")
        self.term_start = np.searchsorted(terms[by_term], np.arange(width + 1))
        self.node, self.middle, self.peak = (np.concatenate(x)[by_term] for x in (nodes, middle, peak))
        # rows in the order of the leaves
        self.order, size = order, np.diff(start)[order]
        self.start = np.cumsum([0, *size])
        own = np.arange(self.start[-1]) + np.repeat(start[order] - self.start[:-1], size)
        self.columns, self.values = columns[own], values[own]
        self.dense = np.zeros(width, np.int64)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node, no row below it scores more."""
        spans = [slice(self.term_start[t], self.term_start[t + 1]) for t in terms]
        w = np.repeat(weights.astype(float), [s.stop - s.start for s in spans])
        node, middle, peak = (np.concatenate([a[s] for s in spans]) for a in (self.node, self.middle, self.peak))
        ball, norm, box = (np.bincount(node, x, len(self.low)) for x in (w * middle, w * w, w * peak))
        return np.minimum(ball + np.sqrt(norm) * self.radius, box) * (1 + RAISED) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, take) -> int:
        """Give take(rows, scores) leaf after leaf, best bound first; it returns the score below which no row matters any
        more. Gives the number of rows scored."""
        bound, scored = self.bounds(terms, weights).tolist(), 0
        self.dense[terms] = weights
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            _, at = heapq.heappop(heap)
            if (child := self.left[at]) >= 0:
                for c in (child, child + 1):
                    if bound[c] >= least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            low, high = self.low[at], self.high[at]
            a, b = self.start[low], self.start[high]
            scores = np.add.reduceat(self.dense[self.columns[a:b]] * self.values[a:b], self.start[low:high] - a)
            scored += high - low
            if scores.max() >= least:
                least = take(self.order[low:high], scores)
        self.dense[terms] = 0
        return scored


class _Best:
    """The k best documents of each query so far: highest score first, then smallest id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def least(self, q: int) -> int:
        return -self.rows[q][-1][0] if len(self.rows[q]) == self.k else 1

    def add(self, q: int, ids: np.ndarray, lost: np.ndarray, scores: np.ndarray) -> int:
        good = np.flatnonzero(scores >= self.least(q))
        good = good[np.lexsort((ids[good], lost[good], -scores[good]))][: self.k]
        more = [(-int(scores[i]), bool(lost[i]), int(ids[i])) for i in good]
        self.rows[q] = sorted(self.rows[q] + more)[: self.k]
        return self.least(q)


def _best_of(block, n_docs: int, n_terms: int, k: int):
    """Tasks: trees over their rows of the index, one after the other, and the k best rows of each query."""

    def tree(parts: list[tuple], queries: Queries, best: _Best) -> None:
        ids, lost, n, size, columns, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        m = 10 + 90 * n * n_docs // n_terms
        values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))
        t = BallTree(np.cumsum([0, *size]), columns, values, len(queries.vocabulary))
        for q, terms in enumerate(queries.terms):
            if len(terms):
                t.search(terms, queries.weights[terms], best.least(q), lambda rows, scores, q=q: best.add(q, ids[rows], lost[rows], scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, parts, held = block.value, [], 0
        best = _Best(len(queries.keys), k)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                terms = batch.column("terms")
                rows = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
                known, columns = queries.places(terms.flatten().to_numpy())
                size = np.bincount(rows[known], minlength=batch.num_rows)
                some = np.flatnonzero(size)  # others score nothing
                ids = batch.column("doc_id")
                lost = ids.is_null().to_numpy(zero_copy_only=False)
                parts.append((ids.fill_null(0).to_numpy()[some].astype(np.int64), lost[some], batch.column("n").to_numpy()[some], size[some], columns, batch.column("tf").flatten().to_numpy()[known]))
                held += len(known)
                if held >= TREE_TERMS:
                    tree(parts, queries, best)
                    parts, held = [], 0
        if held:
            tree(parts, queries, best)
        rows = [(queries.keys[q], None if lost else i, -s) for q, found in enumerate(best.rows) for s, lost, i in found]
        key, ids, scores = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.string()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def _frequencies(index: DataFrame, block) -> dict[int, int]:
    """In how many documents each term of the block occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        n = np.zeros(len(queries.vocabulary), np.int64)
        for batch in batches:
            n += np.bincount(queries.places(batch.column("terms").flatten().to_numpy())[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "df": pa.array(n[some], pa.int64())})

    found = index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.collect()}  # the block's terms at most


def search(index: DataFrame, texts: DataFrame, k: int = 10) -> DataFrame:
    """key, rank, doc_id, score: the k best documents above 0 of an index_terms() table for each of texts (key, text), whose
    keys are unique."""
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    best = None
    if n_docs:
        for block in query_blocks(texts):
            df = _frequencies(index, spark.sparkContext.broadcast(block))
            block.weigh(n_docs, df)
            parts = index.where("n > 0").mapInArrow(_best_of(spark.sparkContext.broadcast(block), n_docs, n_terms, k), "key string, doc_id long, score long")
            rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            found = saved(parts.select("key", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k), "ranked")
            best = found if best is None else best.union(found)
    return spark.createDataFrame([], "key string, rank int, doc_id long, score long") if best is None else best


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "terms")
    index = index_terms(docs)
    index.write.option("compression", "zstd").parquet(path)
    keyed = items.where("text is not null").select("item_id", F.sha2("text", 256).alias("key"), "text")
    found = search(spark.read.schema(index.schema).parquet(path), keyed.select("key", "text").distinct(), k)
    delete(spark, path)
    return keyed.select("item_id", "key").join(found, "key").select("item_id", "rank", "doc_id", "score")


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH dt AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT row_number() OVER () AS r, text FROM documents)),
it AS (SELECT DISTINCT i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT row_number() OVER () AS i, text FROM benchmark)),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM dt GROUP BY ALL),
nn AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM nn),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g WHERE term IN (SELECT term FROM it) GROUP BY term),
s AS (SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM it JOIN w USING (term) JOIN tf USING (term) JOIN nn USING (r), g GROUP BY i, r HAVING score > 0),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN (SELECT row_number() OVER () AS r, doc_id FROM documents) USING (r))
SELECT item_id, rank::INT AS rank, doc_id, score FROM k JOIN (SELECT row_number() OVER () AS i, item_id FROM benchmark) USING (i) WHERE rank <= 10
"""
