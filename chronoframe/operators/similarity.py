"""Search and alignment by correlation: nearest vectors through pivots, lags by blocks of transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores are rounded to so many places; by how much bounds are loosened, for that rounding and for that of doubles.
PLACES, LOOSE = 5, 1.1e-5
#: Candidates of a cell that one task holds.
SLICE = 4096


def _units(column: pd.Series) -> np.ndarray:
    """Vectors less their mean, at length 1; rows of NaN where nothing is left or null."""
    width = next((len(v) for v in column if v is not None), 1)
    v = np.array([np.full(width, np.nan) if x is None else x for x in column], float).reshape(len(column), width)
    v = v - v.mean(axis=1, keepdims=True)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.full_like(v, np.nan), where=size > 0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit vectors."""
    return np.arccos(np.clip(a @ b.T, -1, 1))


class _Cells:
    """Pivots and, of the candidates nearest to each, how near and far they lie and in how many slices. Angles obey the
    triangle inequality, so a query's angle to a pivot bounds those to its candidates from both sides."""

    def __init__(self, near: np.ndarray, far: np.ndarray, slices: np.ndarray):
        self.near, self.far, self.slices = near, far, slices

    def best_score(self, away: np.ndarray) -> np.ndarray:
        """No candidate of a cell is more like a query whose angle to the pivot is this."""
        return np.where(self.slices > 0, np.cos(np.maximum(np.maximum(away - self.far, self.near - away), 0)) + LOOSE, -2)

    def worst_score(self, away: np.ndarray) -> np.ndarray:
        """None is less like it."""
        return np.where(self.slices > 0, np.cos(np.minimum(away + self.far, np.pi)) - LOOSE, 2)


def nearest_of_all(queries: DataFrame, candidates: DataFrame, key: str, pivots: int = 64) -> DataFrame:
    """For each query (key, vec) the candidate with the highest correlation, never itself: pick (of equal ones the smallest),
    score, margin to the worst, and met, the candidates compared with it. Exact: candidates are dealt to their nearest pivot;
    a query meets the cells nearest to it and to its opposite first, then those that the triangle inequality leaves open, and
    in a cell only candidates whose distance to the pivot doesn't rule them out. Large cells are dealt in slices. Vectors
    that are null or constant match nothing."""
    kind = candidates.schema[key].dataType.simpleString()
    spark = candidates.sparkSession
    c = candidates.select(F.col(key).alias("pick"), F.col("vec").cast("array<double>").alias("vec"))
    chosen = c.where("vec is not null").orderBy(F.xxhash64("pick"), "pick").limit(pivots).toPandas()  # bounded by pivots
    centres = _units(chosen["vec"]) if len(chosen) else np.zeros((0, 1))
    centres = centres[~np.isnan(centres).any(axis=1)]
    out = f"id {kind}, pick {kind}, score double, worst double, met long"
    empty = spark.createDataFrame([], f"{key} {kind}, pick {kind}, score double, margin double, met long")
    if not len(centres):
        return empty

    def deal(frames):
        for f in frames:
            u = _units(f["vec"])
            good = ~np.isnan(u).any(axis=1)
            away = _apart(u[good], centres)
            cell = away.argmin(axis=1)
            yield pd.DataFrame({"pick": f["pick"][good].to_numpy(), "vec": pd.Series(list(u[good]), dtype=object), "cell": cell, "away": away[np.arange(len(cell)), cell]})

    dealt = c.mapInPandas(deal, f"pick {kind}, vec array<double>, cell int, away double")
    known = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).toPandas().set_index("cell").reindex(range(len(centres)))  # bounded by pivots
    cells = _Cells(known["near"].fillna(0).to_numpy() - LOOSE, known["far"].fillna(0).to_numpy() + LOOSE, np.ceil(known["n"].fillna(0).to_numpy() / SLICE).astype(int))
    if not cells.slices.any():
        return empty
    slices = F.element_at(F.array(*map(F.lit, cells.slices.tolist())), F.col("cell") + 1)
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("pick"), slices).cast("int"))

    def ask(first: bool):
        """The cells a query goes to, slice by slice: at first the best bound for the nearest and for the worst."""

        def run(frames):
            for f in frames:
                u = _units(f["vec"])
                good = ~np.isnan(u).any(axis=1)
                f, u = f[good], u[good]
                away = _apart(u, centres)
                best, worst = cells.best_score(away), cells.worst_score(away)
                home = np.zeros(best.shape, bool)
                rows = np.arange(len(f))
                home[rows, best.argmax(axis=1)] = home[rows, worst.argmin(axis=1)] = True
                if first:
                    go = home
                else:
                    go = ~home & (cells.slices > 0) & ((best >= f["best"].to_numpy()[:, None] - LOOSE) | (worst <= f["worst"].to_numpy()[:, None] + LOOSE))
                i, j = np.nonzero(go)
                n = cells.slices[j]
                i, j = np.repeat(i, n), np.repeat(j, n)
                s = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                at = {"best": f["best"].to_numpy()[i], "worst": f["worst"].to_numpy()[i]}
                yield pd.DataFrame({"id": f["id"].to_numpy()[i], "vec": pd.Series([u[k] for k in i], dtype=object), "cell": j, "slice": s, "away": away[i, j]} | at)

        return run

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("away", kind="stable")
            vec, away, pick = np.stack(right["vec"].to_list()), right["away"].to_numpy(), right["pick"].to_numpy()
            for q in left.itertuples(index=False):
                best, worst = (-2.0, 2.0) if np.isnan(q.best) else (q.best, q.worst)
                # as near as the best so far, or as far as the worst so far
                reach, out_of = (np.arccos(np.clip(x, -1, 1)) for x in (best - LOOSE, worst + LOOSE))
                a, b = np.searchsorted(away, [q.away - reach - LOOSE, q.away + reach + LOOSE])
                tail = np.searchsorted(away, out_of - q.away - LOOSE)
                for lo, hi in ((a, b), (tail, len(away))) if tail > b else ((min(a, tail), len(away)),):
                    if lo < hi:
                        score = np.round(vec[lo:hi] @ q.vec, PLACES)
                        other = pick[lo:hi] != q.id
                        if other.any():
                            top, low = score[other].max(), score[other].min()
                            found.append((q.id, pick[lo:hi][other & (score == top)].min(), top, low, hi - lo))
        return pd.DataFrame(found, columns=["id", "pick", "score", "worst", "met"])

    schema = f"id {kind}, vec array<double>, cell int, slice int, away double, best double, worst double"
    at = ["cell", "slice"]
    whole = lambda met: met.groupBy("id").agg(F.max_by(F.struct("pick", "score"), F.struct("score", -F.col("pick"))).alias("x"), F.min("worst").alias("worst"), F.sum("met").alias("met"))
    q = queries.select(F.col(key).alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    asked = q.withColumns({"best": F.lit(None).cast("double"), "worst": F.lit(None).cast("double")}).mapInPandas(ask(True), schema)
    near = asked.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInPandas(meet, out)
    so_far = whole(near).select("id", F.col("x.score").alias("best"), "worst")
    # a query whose first cells hold only itself asks everywhere
    rest = q.join(so_far, "id", "left").select("id", "vec", F.coalesce("best", F.lit(-2.0)).alias("best"), F.coalesce("worst", F.lit(2.0)).alias("worst")).mapInPandas(ask(False), schema)
    far = rest.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInPandas(meet, out)
    return whole(near.union(far)).select(F.col("id").alias(key), "x.*", F.round(F.col("x.score") - F.col("worst"), PLACES).alias("margin"), "met")


def share_per_pick(picks: DataFrame, by: list[str], pick: str, seconds: str) -> DataFrame:
    """Seconds given to each pick, and their share of all."""
    each = picks.groupBy(*by, pick).agg(F.sum(seconds).alias("seconds"))
    total = each.groupBy(*by).agg(F.sum("seconds").alias("_all")) if by else each.agg(F.sum("seconds").alias("_all"))
    each = each.join(total, by) if by else each.join(F.broadcast(total))  # one row
    return each.select(*by, pick, F.round("seconds", 3).alias("seconds"), F.round(F.try_divide("seconds", "_all"), 4).alias("share"))


def lag_align(a: DataFrame, b: DataFrame, by: list[str], max_lag: int, block: int | None = None) -> DataFrame:
    """Lag of b (in bins) with the highest correlation to a over the bins that both have, and that correlation; both are
    (bin, v), rows without v count as missing, and at least three bins must meet. Correlations of all lags come from
    transforms over blocks of bins of a with the bins of b within max_lag of them (overlap-save): counts, sums, squares and
    products of each block are added up by lag. Of equal ones the lag nearest to 0, then the larger."""
    block = block or max(4 * max_lag, 256)
    given = lambda df: df.where("v is not null and bin is not null").withColumn("bin", F.col("bin").cast("long"))
    centre = given(a).groupBy(*by).agg(F.avg("v").alias("_m")).join(given(b).groupBy(*by).agg(F.avg("v").alias("_k")), by)
    keys = [F.col(c).alias(c) for c in by]  # new columns: a and b may come from one table
    x = given(a).join(centre, by).select(*keys, F.floor(F.col("bin") / block).alias("_block"), "bin", (F.col("v") - F.col("_m")).cast("double").alias("v"))
    last = F.floor((F.col("bin") + max_lag) / block)
    y = given(b).join(centre, by).select(*keys, F.explode(F.sequence(F.floor((F.col("bin") - max_lag) / block), last)).alias("_block"), "bin", (F.col("v") - F.col("_k")).cast("double").alias("v"))
    size = 1 << int(2 * block + 2 * max_lag).bit_length()
    lags = np.arange(-max_lag, max_lag + 1)
    sums = ["n", "v", "w", "vv", "ww", "vw"]

    def dense(f: pd.DataFrame, start: int, width: int) -> list[np.ndarray]:
        at, v = f["bin"].to_numpy() - start, f["v"].to_numpy()
        return [np.fft.rfft(np.bincount(at, w, width), size) for w in (None, v, v * v)]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*by, "lag", *sums])
        start = int(left["_block"].iloc[0]) * block
        one, two = dense(left, start, block), dense(right, start - max_lag, block + 2 * max_lag)
        pair = lambda p, q: np.fft.irfft(np.conj(one[p]) * two[q], size)[: 2 * max_lag + 1]
        out = pd.DataFrame({"lag": lags, "n": np.round(pair(0, 0)).astype(int), "v": pair(1, 0), "w": pair(0, 1), "vv": pair(2, 0), "ww": pair(0, 2), "vw": pair(1, 1)})
        for c in reversed(by):
            out.insert(0, c, left[c].iloc[0])
        return out[out["n"] > 0]

    kinds = ", ".join(f"{c} {a.schema[c].dataType.simpleString()}" for c in by)
    met = x.groupBy(*by, "_block").cogroup(y.groupBy(*by, "_block")).applyInPandas(run, f"{kinds}, lag int, n long, v double, w double, vv double, ww double, vw double")
    t = met.groupBy(*by, "lag").agg(*(F.sum(c).alias(c) for c in sums)).where("n >= 3")
    n = F.col("n")
    v, w, vw = F.col("vv") - F.col("v") ** 2 / n, F.col("ww") - F.col("w") ** 2 / n, F.col("vw") - F.col("v") * F.col("w") / n
    # what transforms leave of a variance of none
    r = F.when((v > 1e-9 * F.col("vv")) & (w > 1e-9 * F.col("ww")) & (v > 1e-12) & (w > 1e-12), F.round(vw / F.sqrt(v * w), 6))
    t = t.select(*by, F.col("lag"), r.alias("r")).where("r is not null")
    return t.groupBy(*by).agg(F.max_by(F.struct("lag", "r"), F.struct("r", -F.abs("lag"), "lag")).alias("x")).select(*by, "x.*")


def projection_shift(a: Column | str, b: Column | str, max_lag: int) -> Column:
    """Shift of array b against array a, up to max_lag either way, with the highest correlation of what overlaps, both less
    their means; of equal ones the lowest shift. Null arrays give null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    less = lambda v: F.zip_with(v, F.array_repeat(add(v) / F.greatest(F.size(v), F.lit(1)), F.size(v)), lambda x, m: x - m)
    dot = lambda p, q: add(F.zip_with(p, q, lambda x, y: x * y))

    def best(both: Column) -> Column:
        p, q = both["p"], both["q"]

        def scored(k: Column) -> Column:
            n = F.greatest(F.least(F.size(p), F.size(q)) - F.abs(k), F.lit(0))
            x, y = F.slice(p, F.greatest(-k, F.lit(0)) + 1, n), F.slice(q, F.greatest(k, F.lit(0)) + 1, n)
            score = lambda z: dot(z["x"], z["y"]) / (F.sqrt(dot(z["x"], z["x"]) * dot(z["y"], z["y"])) + 1e-9)
            return F.struct(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), score)[0].alias("s"), (-k).alias("k"))

        return -F.array_max(F.transform(F.sequence(F.lit(-max_lag), F.lit(max_lag)), scored))["k"]

    both = F.struct(less(a.cast("array<double>")).alias("p"), less(b.cast("array<double>")).alias("q"))
    return F.when(a.isNotNull() & b.isNotNull(), F.transform(F.array(both), best)[0])
