"""Operators over vectors held as arrays: steps between rows, stacks around boundaries, references of a whole group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import index_runs
from .windows import blend_fit

#: Weights of layout, structure, content and scale in a step, the step under which it is a jump, histogram
#: bins, the share of a side that a profile may shift, and blocks per side.
LAYOUT, STRUCTURE, CONTENT, SCALE, JUMP = 0.30, 0.25, 0.30, 0.15, 0.20
BINS, SHIFT, BLOCK_ROWS, BLOCK_COLUMNS = 32, 0.125, 4, 8

_STEP = "delta double, content double, layout double, structure double, scale double, jump boolean"


def _correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, 0 where either side is zero."""
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)


def _profiles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Best correlation of two profiles over small shifts, at least 0; a best shift at the limit counts as none."""
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    n, most = x.shape[1], max(1, round(x.shape[1] * SHIFT))
    shifts = range(-most, most + 1)
    found = np.stack([_correlation(x[:, max(0, k) : n + min(0, k)], y[:, max(0, -k) : n - max(0, k)]) for k in shifts], axis=1)
    best = found.argmax(axis=1)
    inner = np.where(np.isin(best, (0, 2 * most)), found[:, most], found.max(axis=1))
    flat_x, flat_y = np.isclose(x, 0).all(axis=1), np.isclose(y, 0).all(axis=1)
    return np.maximum(np.where(flat_x & flat_y, 1.0, np.where(flat_x | flat_y, 0.0, inner)), 0.0)


def _block_means(x: np.ndarray) -> np.ndarray:
    rows, columns = (np.array_split(np.arange(n), min(n, k)) for n, k in zip(x.shape[1:], (BLOCK_ROWS, BLOCK_COLUMNS)))
    means = np.stack([x[:, r][:, :, c].mean(axis=(1, 2)) for r in rows for c in columns], axis=1)
    return means - means.mean(axis=1, keepdims=True)


def _spread(x: np.ndarray) -> np.ndarray:
    """How widely the mass over the least value of either profile lies, both sides taken together."""
    sides = []
    for axis in (1, 2):
        mass = x.mean(axis=axis)
        mass = mass - mass.min(axis=1, keepdims=True)
        at, total = np.arange(mass.shape[1]) / mass.shape[1], mass.sum(axis=1)
        share = np.divide(mass, total[:, None], out=np.zeros_like(mass), where=total[:, None] > 0)
        mean = (share * at).sum(axis=1, keepdims=True)
        sides.append(np.sqrt((share * (at - mean) ** 2).sum(axis=1)))
    return np.sqrt(sides[0] * sides[1])


def step_values(before: np.ndarray, after: np.ndarray, columns: int) -> pd.DataFrame:
    """The step between pictures of values 0 to 1, one pair a row, `columns` elements to a line."""
    share = [np.stack([np.histogram(v, bins=BINS, range=(0, 1))[0] for v in x]) / x.shape[1] for x in (before, after)]
    content = np.abs(share[0] - share[1]).sum(axis=1) / 2
    x, y = (v.reshape(len(v), -1, columns) for v in (before, after))
    layout = 1 - (_profiles(x.mean(axis=1), y.mean(axis=1)) + _profiles(x.mean(axis=2), y.mean(axis=2))) / 2
    bx, by = _block_means(x), _block_means(y)
    flat = np.isclose(bx, 0).all(axis=1).astype(int) + np.isclose(by, 0).all(axis=1)
    structure = np.where(flat == 2, 0.0, np.where(flat == 1, 1.0, 1 - np.maximum(_correlation(bx, by), 0)))
    sx, sy = _spread(x), _spread(y)
    known = (sx > 0) & (sy > 0)
    scale = np.where(known, np.minimum(np.abs(np.log2(np.where(known, sy, 1) / np.where(known, sx, 1))), 1), 0.0)
    delta = LAYOUT * layout + STRUCTURE * structure + CONTENT * content + SCALE * scale
    out = pd.DataFrame({"delta": delta, "content": content, "layout": layout, "structure": structure, "scale": scale})
    return out.round(4).assign(jump=delta < JUMP)


def vector_step(df: DataFrame, by: list[str], vec: str, order: str, columns: int) -> DataFrame:
    """The step of a picture since the row before: content, layout, structure, scale, their weighted sum and whether that is
    a jump; null for the first row of a key and where either vector is null."""

    @F.pandas_udf(_STEP)
    def step(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        known = before.notna() & after.notna()
        out = pd.DataFrame(index=before.index, columns=["delta", "content", "layout", "structure", "scale", "jump"], dtype=object)
        if known.any():
            stacked = [np.stack(list(x[known])).astype(float) for x in (before, after)]
            out.loc[known] = step_values(*stacked, columns).to_numpy(object)
        return out.astype({c: float for c in out.columns[:-1]}).assign(jump=out["jump"].astype("boolean"))

    was = F.lag(vec).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_s", step(was, F.col(vec))).select("*", "_s.*").drop("_s")


def step_median_stack(frames: DataFrame, cuts: DataFrame, by: list[str], vec: str, order: str, at: str, k: int = 3, guard: int = 1) -> DataFrame:
    """Per boundary (the first row after it) and side, the element-wise median of k rows, guard rows away from it. A side with
    fewer rows has none."""
    sides = [(name, offset) for name, first in (("out", -guard - k), ("in", guard)) for offset in range(first, first + k)]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("side"), (F.col(at) + offset).alias("pos")) for name, offset in sides))).alias("_w")
    want = cuts.select(*by, at, each).select(*by, at, F.col("_w.side").alias("side"), F.col("_w.pos").alias(order))
    cells = want.join(frames.select(*by, order, vec), [*by, order]).select(*by, at, "side", F.posexplode(vec).alias("_e", "_x"))
    medians = cells.groupBy(*by, at, "side", "_e").agg(F.median("_x").alias("_m"), F.count("*").alias("_n")).where(F.col("_n") == k)
    stack = F.transform(F.array_sort(F.collect_list(F.struct("_e", "_m"))), lambda x: x["_m"])
    return medians.groupBy(*by, at, "side").agg(stack.alias("stack"))


def lost_picture(df: DataFrame, by: list[str], vec: str, order: str, dark: float, usual: float = 0.25, hide: float = 0.05) -> DataFrame:
    """Per row the shares of its elements that are dark, dark where the key seldom is (novel), and dark by more than `hide`
    under the key's own median there (hidden). Occupancy and median are per element over the whole key."""
    cells = df.select(*by, order, F.posexplode(vec).alias("_e", "_x")).withColumn("_on", F.col("_x") <= dark)
    spot = Window.partitionBy(*by, "_e")
    cells = cells.withColumns({"_occ": F.avg(F.col("_on").cast("double")).over(spot), "_ref": F.percentile("_x", F.lit(0.5)).over(spot)})
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return cells.groupBy(*by, order).agg(
        share(F.col("_on")).alias("coverage"), share(F.col("_on") & (F.col("_occ") < usual)).alias("novel"), share(F.col("_on") & (F.col("_ref") - F.col("_x") > hide)).alias("hidden")
    )


def obstruction_catalog(samples: DataFrame, by: list[str], index: str, threshold: float, novel: float = 0.035, hidden: float = 0.025, gap: int = 1) -> DataFrame:
    """Windows of samples whose score reaches the threshold, one other bridged: an obstruction where any sample has enough
    novel or hidden share, else scene."""
    aggs = [F.round(F.max("score"), 6).alias("peak_score"), F.round(F.max("novel"), 6).alias("peak_novel"), F.round(F.max("hidden"), 6).alias("peak_hidden")]
    found = index_runs(samples, by, index, F.col("score") >= threshold, gap, aggs)
    return found.withColumn("kind", F.when((F.col("peak_novel") >= novel) | (F.col("peak_hidden") >= hidden), "obstruction").otherwise("scene"))


def _centred(v: Column) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.transform(v, lambda x: x - mean)


def ghost_events(df: DataFrame, by: list[str], vec: str, order: str, half: int, change: float, merge: int, residual: float = 0.25, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Rows that are a blend of those `half` before and after, while these differ in structure, grouped over `merge` rows."""
    w = Window.partitionBy(*by).orderBy(order)
    d = blend_fit(df.withColumns({"_before": F.lag(vec, half).over(w), "_after": F.lead(vec, half).over(w)}), by, vec, order, half)
    apart = F.zip_with(_centred(F.col("_after")), _centred(F.col("_before")), lambda a, b: F.abs(a - b))
    d = d.withColumn("change", F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.size(vec)).drop("_before", "_after")
    hit = (F.col("residual") <= residual) & F.col("alpha").between(low, high) & (F.col("change") >= change)
    aggs = [F.round(F.max("residual"), 3).alias("residual"), F.round(F.min("alpha"), 3).alias("alpha_low"), F.round(F.max("alpha"), 3).alias("alpha_high"), F.round(F.max("change"), 3).alias("change")]
    return index_runs(d, by, order, F.coalesce(hit, F.lit(False)), merge - 1, aggs)


def edges_of_presence(df: DataFrame, anchors: DataFrame, by: list[str], vec: str, order: str, tolerance: float, share: float, lift: float) -> DataFrame:
    """From an anchor row (anchor, mask: element indices) out to both sides: the rows whose masked elements still match the
    anchor's, then the ramp of rows whose masked elements still stand out from the whole by `lift`."""
    held = anchors.join(df.select(*by, F.col(order).alias("anchor"), F.col(vec).alias("_held")), [*by, "anchor"])
    d = df.join(held.select(*by, "anchor", "mask", "_held"), by)
    picked = lambda v: F.transform("mask", lambda i: F.get(v, i))
    same = F.zip_with(picked(F.col(vec)), picked(F.col("_held")), lambda a, b: (F.abs(a - b) <= tolerance).cast("double"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    d = d.select(*by, order, "anchor", (mean(same) >= share).alias("_match"), (mean(picked(F.col(vec))) - mean(F.col(vec)) >= lift).alias("_drawn"))
    o, key = F.col(order), Window.partitionBy(*by)
    ends = {"_low": F.min(o).over(key), "_high": F.max(o).over(key)}
    d = d.withColumns(ends).withColumns({
        "first": F.coalesce(F.max(F.when((o < F.col("anchor")) & ~F.col("_match"), o)).over(key) + 1, F.col("_low")),
        "last": F.coalesce(F.min(F.when((o > F.col("anchor")) & ~F.col("_match"), o)).over(key) - 1, F.col("_high")),
    })
    ramp_in = F.col("first") - 1 - F.coalesce(F.max(F.when((o < F.col("first")) & ~F.col("_drawn"), o)), F.col("_low") - 1)
    ramp_out = F.coalesce(F.min(F.when((o > F.col("last")) & ~F.col("_drawn"), o)), F.col("_high") + 1) - F.col("last") - 1
    return d.groupBy(*by, "anchor", "first", "last", "_low", "_high").agg(ramp_in.alias("ramp_in"), ramp_out.alias("ramp_out")).drop("_low", "_high")
