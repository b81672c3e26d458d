"""K-means over integer vectors with ns-bounds.

For each vector and centroid the exact squared distance of its last evaluation and the round of it are kept. A bound on
the distance now is that distance loosened by how far the centroid has moved in all since then: the norm of one
displacement, taken from the kept history of centroids, which is never more than the sum of its drifts round by round.
Where every other centroid's lower bound is above the upper bound of the vector's own, nothing is computed. Else the
own distance is evaluated anew, and then those of the centroids whose bounds still fail; ties go to the smaller number.
Bounds are rounded outwards, distances are integers, so the result is that of a full scan.

The state is a table written each round, dealt as the input is; a round needs the centroids of all rounds so far (k
vectors each) in its tasks and gives back one sum for each centroid and component. No vector moves between tasks.

Defined results: vectors that are null, of another length, or hold null, NaN or infinite components are left out; so
are those with a component of 2**21 or more in size, whose squared distances need not fit 64 bits. Rows that repeat a
vec_id are vectors of their own; a null vec_id stays null and starts as an empty one would. Fewer vectors than k give
as many centroids as vectors; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, new_path, table

#: Rounding of the bounds, far above that of the few operations on doubles they are made of.
ROUNDING = 1e-12
#: Components of this size and more are left out.
LARGEST = 1 << 27
_STATE = "vec_id {}, v array<int>, cluster int, squared array<long>, round array<int>, evaluated long"


def integer_vectors(vectors: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component of the vectors of dim finite ones."""
    usable = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST))
    return vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def first_by_hash(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.square(v - c).sum(1)


class NsBounds:
    """One round's work on a batch: history holds the centroids of each round, the last being those now."""

    def __init__(self, history: list[np.ndarray]):
        self.now, self.round = history[-1], len(history) - 1
        # how far each centroid has come since each round
        self.moved = np.array([np.sqrt(np.square((self.now - c).astype(float)).sum(1)) for c in history]) * (1 + ROUNDING)

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        squared = np.stack([_squared(v, c) for c in self.now], 1)
        return squared.argmin(1), squared, np.zeros(squared.shape, np.int32), np.full(len(v), len(self.now))

    def assign(self, v: np.ndarray, own: np.ndarray, squared: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The new cluster of each vector, the state after it, and how many distances were evaluated."""
        own, squared, seen, every = own.copy(), squared.copy(), seen.copy(), np.arange(len(v))
        k = len(self.now)
        away, moved = np.sqrt(squared.astype(float)), self.moved[seen, np.arange(k)]
        low = (away - moved) * (1 - ROUNDING) - ROUNDING
        low[every, own] = np.inf
        high = (away[every, own] + moved[every, own]) * (1 + ROUNDING)
        evaluated = np.zeros(len(v), np.int64)
        unsure = np.flatnonzero((low <= high[:, None]).any(1))
        self._own_anew(v, own, squared, seen, evaluated, unsure)
        high[unsure] = np.sqrt(squared[unsure, own[unsure]].astype(float)) * (1 + ROUNDING)
        i, j = np.nonzero(low[unsure] <= high[unsure, None])
        i = unsure[i]
        for a in range(0, len(i), 1 << 14):
            ia, ja = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            squared[ia, ja] = _squared(v[ia], self.now[ja])
        seen[i, j] = self.round
        evaluated += np.bincount(i, minlength=len(v))
        rivals = np.full(low.shape, np.iinfo(np.int64).max)
        rivals[i, j] = squared[i, j]
        rivals[unsure, own[unsure]] = squared[unsure, own[unsure]]
        own[unsure] = rivals[unsure].argmin(1)
        return own, squared, seen, evaluated

    def _own_anew(self, v: np.ndarray, own: np.ndarray, squared: np.ndarray, seen: np.ndarray, evaluated: np.ndarray, rows: np.ndarray) -> None:
        rows = rows[seen[rows, own[rows]] != self.round]
        squared[rows, own[rows]] = _squared(v[rows], self.now[own[rows]])
        seen[rows, own[rows]] = self.round
        evaluated[rows] += 1

    def settle(self, v: np.ndarray, own: np.ndarray, squared: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exact squared distance of each vector to its own centroid now, and how many of them were evaluated for it."""
        squared, seen, evaluated = squared.copy(), seen.copy(), np.zeros(len(v), np.int64)
        self._own_anew(v, own, squared, seen, evaluated, np.arange(len(v)))
        return squared[np.arange(len(v)), own], evaluated


def _round(history: list[np.ndarray], dim: int):
    """Tasks of one round: from (vec_id, v) in the first, from the state in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, k = NsBounds(history), len(history[-1])
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                v = _rows(batch.column("v"), dim).astype(np.int64)
                if len(history) == 1:
                    own, squared, seen, evaluated = bounds.first(v)
                else:
                    own, squared, seen, evaluated = bounds.assign(v, batch.column("cluster").to_numpy(), _rows(batch.column("squared"), k), _rows(batch.column("round"), k))
                    evaluated = evaluated + batch.column("evaluated").to_numpy()
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": batch.column("v"), "cluster": pa.array(own, pa.int32()), "squared": _lists(squared, pa.int64()), "round": _lists(seen, pa.int32()), "evaluated": pa.array(evaluated, pa.int64())})

    return run


def _settled(history: list[np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, k = NsBounds(history), len(history[-1])
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            squared, evaluated = bounds.settle(_rows(batch.column("v"), dim).astype(np.int64), own, _rows(batch.column("squared"), k), _rows(batch.column("round"), k))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": batch.column("cluster"), "distance": pa.array(squared, pa.int64()), "evaluated": pa.array(batch.column("evaluated").to_numpy() + evaluated, pa.int64())})

    return run


def _sums(k: int, dim: int):
    """One row for each cluster and component of a task: number of vectors and sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            own, v = batch.column("cluster").to_numpy(), _rows(batch.column("v"), dim).astype(np.int64)
            for j in np.unique(own):
                n[j] += (own == j).sum()
                total[j] += v[own == j].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(some, dim), pa.int32()), "component": pa.array(np.tile(np.arange(dim), len(some)), pa.int32()), "n": pa.array(np.repeat(n[some], dim), pa.int64()), "total": pa.array(total[some].ravel(), pa.int64())})

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean, componentwise; those without vectors stay."""
    k, dim = centroids.shape
    parts = state.select("cluster", "v").mapInArrow(_sums(k, dim), "cluster int, component int, n long, total long")
    sums = parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # k * dim rows at most
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Rounds of assignment and update, then one assignment more, of vectors (vec_id, v). Gives vec_id, cluster, distance
    (squared, to the last centroids) and evaluated (distances computed for the vector; a full scan takes (rounds + 1) * k),
    and the centroids of each round."""
    spark, history, dim = vectors.sparkSession, [centroids], centroids.shape[1]
    schema = _STATE.format(vectors.schema["vec_id"].dataType.simpleString())
    state, held = vectors.select("vec_id", "v"), None
    for r in range(rounds + 1):
        path = new_path(spark, "ns-bounds")
        state.mapInArrow(_round(list(history), dim), schema).write.option("compression", "zstd").parquet(path)
        if held:
            delete(spark, held)
        state, held = spark.read.schema(schema).parquet(path), path
        if r < rounds:
            history.append(_moved(state, history[-1]))
    kind = schema.split(",")[0]
    return state.mapInArrow(_settled(history, dim), f"{kind}, cluster int, distance long, evaluated long"), history


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, evaluated."""
    spark, v = vectors.sparkSession, integer_vectors(vectors, dim, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    start = first_by_hash(v, k)
    if not len(start):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, evaluated long")
    rows, history = cluster(v, start, rounds)
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    known = spark.createDataFrame([(j, s, sum(inertia.values()), digest[j]) for j, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "evaluated")


def op12_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop("evaluated")


def _oracle(rounds: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT v.i, arg_min(c.c, {{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS c, min(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM v, c{r} c GROUP BY v.i)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, k, sum(x) AS s, count(*) AS n FROM (SELECT a{r}.c, generate_subscripts(v.v, 1) AS k, unnest(v.v) AS x FROM a{r} JOIN v USING (i)) GROUP BY c, k)")
            steps.append(f"n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS v FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n USING (c))")
    return f"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM v QUALIFY c < 16),
{", ".join(steps)}
SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (i) JOIN c{rounds} c ON c.c = a.c
"""


OP12_SQL = _oracle()
