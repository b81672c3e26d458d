"""Gaps and islands: runs over thresholds, merged and filtered spans, hysteresis, layers and ordered folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Covers, Spacing, ZigZag, by_time, fold_in_chunks, in_groups


def _before(by: list[str], order: str = "t"):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def runs(df: DataFrame, by: list[str], on: Column, peak: str, closing: Column | None = None) -> DataFrame:
    """Maximal runs of rows where `on`: start, stop (time of the first row after, or the last row + its step), rows, peak."""
    w = Window.partitionBy(*by).orderBy("t")
    step = F.coalesce(F.lead("t").over(w), 2 * F.col("t") - F.lag("t").over(w), F.col("t"))
    df = df.withColumns({"_on": F.coalesce(on, F.lit(False)), "_stop": step})
    new = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    df = df.withColumn("_i", F.sum(new.cast("int")).over(_before(by))).where("_on")
    return df.groupBy(*by, "_i").agg(F.min("t").alias("start"), F.max("_stop").alias("stop"), F.count("*").alias("rows"), F.max(peak).alias("peak")).drop("_i")


def threshold_runs(df: DataFrame, by: list[str], level: str, threshold: float) -> DataFrame:
    return runs(df, by, F.col(level) >= threshold, level)


def merge_gaps(spans: DataFrame, by: list[str], gap: float) -> DataFrame:
    """Spans with a hole under `gap` join; the peak is the larger."""
    w = Window.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") - reach >= gap, F.lit(True))
    s = spans.withColumn("_new", new.cast("int")).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("rows").alias("rows"), F.max("peak").alias("peak")).drop("_i")


def min_length(spans: DataFrame, seconds: float) -> DataFrame:
    return spans.where(F.col("stop") - F.col("start") >= seconds)


def bursts(df: DataFrame, by: list[str], level: str, threshold: float, gap: float, seconds: float) -> DataFrame:
    return min_length(merge_gaps(threshold_runs(df, by, level, threshold), by, gap), seconds)


def complement(spans: DataFrame, totals: DataFrame, by: list[str], least: float) -> DataFrame:
    """Stretches between spans from `first` to `last` of a recording, with the length of the span on each side."""
    w = Window.partitionBy(*by).orderBy("start")
    length = F.col("stop") - F.col("start")
    s = spans.join(totals, by).withColumns({"_prev": F.lag("stop").over(w), "_plen": F.lag(length).over(w), "_next": F.lead("start").over(w)})
    heads = s.select(*by, F.coalesce("_prev", "first").alias("a"), F.col("start").alias("b"), F.col("_plen").alias("before"), length.alias("after"))
    tails = s.where("_next is null").select(*by, F.col("stop").alias("a"), F.col("last").alias("b"), length.alias("before"), F.lit(None).cast("double").alias("after"))
    return heads.unionByName(tails).withColumnsRenamed({"a": "start", "b": "stop"}).where(F.col("stop") - F.col("start") >= least)


def below_runs(df: DataFrame, by: list[str], level: str, threshold: float, least: float, limit: Column | None = None) -> DataFrame:
    """Runs strictly under the threshold of at least `least` seconds; stops capped at the limit."""
    r = runs(df, by, F.col(level) < threshold, level)
    if limit is not None:
        r = r.withColumn("stop", F.least("stop", limit))
    return min_length(r, least)


def merge_regions(words: DataFrame, by: list[str], below: Column, order: str, text: str) -> DataFrame:
    """Neighbouring rows under a floor as one region: first, last, count and joined text."""
    w = Window.partitionBy(*by).orderBy(order)
    d = words.withColumn("_on", F.coalesce(below, F.lit(False)))
    new = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    d = d.withColumn("_i", F.sum(new.cast("int")).over(_before(by, order))).where("_on")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return d.groupBy(*by, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), joined.alias("text")).drop("_i")


def index_runs(df: DataFrame, by: list[str], index: str, flag: Column, gap: int, aggs: list[Column] = ()) -> DataFrame:
    """Runs of flagged rows, bridging at most `gap` others; half-open indices."""
    w = Window.partitionBy(*by).orderBy(index)
    d = df.where(flag)
    d = d.withColumn("_new", F.coalesce(F.col(index) - F.lag(index).over(w) > gap + 1, F.lit(True)).cast("int"))
    d = d.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_i").agg(F.min(index).alias("first"), (F.max(index) + 1).alias("end"), F.count("*").alias("n"), *aggs).drop("_i")


def hysteresis_state(df: DataFrame, by: list[str], level: str, opens: float, closes: float) -> DataFrame:
    """open: turned on at or over `opens`, off under `closes`, else as before."""
    mark = F.when(F.col(level) >= opens, True).when(F.col(level) < closes, False)
    return df.withColumn("open", F.coalesce(F.last(mark, ignorenulls=True).over(_before(by)), F.lit(False)))


def hysteresis_runs(df: DataFrame, by: list[str], level: str, opens: float, closes: float) -> DataFrame:
    return runs(hysteresis_state(df, by, level, opens, closes), by, F.col("open"), level)


def seed_and_grow(df: DataFrame, by: list[str], index: str, seed: Column, hold: Column, bridge: int) -> DataFrame:
    """Runs of hold rows (bridging gaps) that have a seed."""
    r = index_runs(df, by, index, hold, bridge, [F.max(seed.cast("int")).alias("_seed")])
    return r.where("_seed = 1").drop("_seed")


def class_spans(df: DataFrame, by: list[str], label: str, end: Column | None = None) -> DataFrame:
    """Adjacent equal labels as spans; one ends where the next begins, the last at its last row or `end`."""
    w = Window.partitionBy(*by).orderBy("t")
    d = df.withColumn("_new", (~F.coalesce(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag("t").over(w).isNotNull(), F.lit(False))).cast("int")).withColumn("_last", F.max("t").over(Window.partitionBy(*by)))
    d = d.where("_new = 1")
    return d.select(*by, F.col("t").alias("start"), F.coalesce(F.lead("t").over(w), end if end is not None else F.col("_last")).alias("stop"), F.col(label).alias("label"))


def segments_from_cuts(cuts: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Cut times to segments [first, c1, ..., last); empty ones are dropped."""
    points = bounds.select(*by, F.explode(F.array("first", "last")).alias("t")).union(cuts.select(*by, "t")).distinct()
    return points.select(*by, F.col("t").alias("start"), F.lead("t").over(Window.partitionBy(*by).orderBy("t")).alias("stop")).where("stop > start")


def top_layer(items: DataFrame, by: list[str], key: str, width: float) -> DataFrame:
    """Stacked layers flattened: split at every edge, the highest layer wins, uncovered stretches are black, equal neighbours join. No trailing black."""
    from .joins import overlap_join

    edges = items.select(*by, F.explode(F.array("start", "stop")).alias("start")).distinct()
    cells = edges.withColumn("stop", F.lead("start").over(Window.partitionBy(*by).orderBy("start"))).where("stop is not null")
    over = overlap_join(cells, items.select(*by, F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), "layer", key), by, width)
    best = over.groupBy(*by, "start").agg(F.max_by(key, F.struct("layer", key)).alias(key))
    cells = cells.join(best, [*by, "start"], "left").withColumn("t", F.col("start"))
    w = Window.partitionBy(*by).orderBy("start")
    new = ~F.coalesce(F.lag(key).over(w).eqNullSafe(F.col(key)) & F.lag("stop").over(w).isNotNull(), F.lit(False))
    cells = cells.withColumn("_i", F.sum(new.cast("int")).over(_before(by, "start")))
    return cells.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(key).alias(key)).withColumn("black", F.col(key).isNull()).drop("_i")


def thin(df: DataFrame, by: list[str], gap: float, out: str = "t", chunk: float | None = None) -> DataFrame:
    """Greedy: a row stays if it is gap or more after the last that stayed. `chunk`: seconds of a recording that one task takes."""
    rows = df.where("t is not null").select(*by, "t")
    return fold_in_chunks(rows, by, ["t"], by_time("t", chunk), Spacing("t", gap, "t"), f"{out} double")


def spaced_top_k(df: DataFrame, by: list[str], key: str, score: str, spacing: float, k: int) -> DataFrame:
    """Greedy: best score first (then earliest, then smallest key), rows within the spacing of one already picked are passed
    over; at most k (the feature). What can be among the k of a key passes through one task in order, not held."""
    rows = df.where(F.col(score).isNotNull() & F.col("t").isNotNull()).select(*by, (-F.col(score)).alias("_s"), "t", F.col(key).alias("_k"))
    # rows that can't be among the k: of the best rows of every other bucket as wide as the spacing, each pick passes over two at most
    x = F.struct("_s", "t", "_k")
    tops = rows.groupBy(*by, F.floor(F.col("t") / spacing).alias("_b")).agg(F.min(x).alias("_x")).withColumn("_b", F.pmod("_b", F.lit(2)))
    tops = tops.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_x"))).where(F.col("_n") == 2 * k - 1)
    floor = tops.groupBy(*by).agg(F.min("_x").alias("_floor"))
    rows = rows.join(floor, by, "left").where(F.col("_floor").isNull() | (x <= F.col("_floor"))).drop("_floor")

    def pick(group: dict, picked: list | None) -> tuple[list[tuple], list]:
        picked, found, t = picked or [], [], group["t"]
        free = np.ones(len(t), bool)
        for p in picked:
            free &= np.abs(p - t) >= spacing
        while len(picked) < k and free.any():
            j = int(free.argmax())
            picked.append(t[j])
            found.append((len(picked), group["_k"][j]))
            free &= np.abs(t[j] - t) >= spacing
        return found, picked

    return in_groups(rows, by, ["_s", "t", "_k"], pick, f"rank int, {key} {df.schema[key].dataType.simpleString()}", carry=True)


def legs(df: DataFrame, by: list[str], level: str, step: float, chunk: float | None = None) -> DataFrame:
    """Zig-zag legs: a reversal of `step` closes one. `chunk`: seconds of a recording that one task takes."""
    rows = df.where(F.col("t").isNotNull() & F.col(level).isNotNull()).select(*by, "t", level)
    return fold_in_chunks(rows, by, ["t"], by_time("t", chunk), ZigZag("t", level, step), "t_from double, v_from double, t_to double, v_to double")


def leader_runs(df: DataFrame, by: list[str], least: float) -> DataFrame:
    """Runs of a non-null leader (nobody never closes one); a short run folds into the one kept before it, a short leading run
    drops. Short runs only stretch what is before them, so the first run and the long ones stand for all."""
    w = Window.partitionBy(*by).orderBy("t")
    d = df.where("leader is not null").withColumn("_new", F.coalesce(F.lag("leader").over(w) != F.col("leader"), F.lit(True)))
    last = df.groupBy(*by).agg(F.max("t").alias("_end"))
    r = d.where("_new").select(*by, "t", "leader", F.lead("t").over(w).alias("_next"), F.lag("t").over(w).isNull().alias("_first")).join(last, by)
    r = r.where(F.col("_first") | (F.coalesce("_next", "_end") - F.col("t") >= least))
    r = r.withColumn("_new", F.coalesce(F.lag("leader").over(w) != F.col("leader"), F.lit(True))).where("_new")
    r = r.select(*by, F.col("t").alias("start"), F.coalesce(F.lead("t").over(w), F.col("_end")).alias("stop"), "leader")
    return r.where(F.col("stop") - F.col("start") >= least)


def moving_runs(df: DataFrame, by: list[str], still: float, least: float, gap: float) -> DataFrame:
    """Runs where a step moves, joined over short gaps, of at least `least` seconds, with the net displacement."""
    from .joins import point_in_interval

    on = (F.abs("dx") >= still) | (F.abs("dy") >= still)
    spans = min_length(merge_gaps(runs(df.withColumn("_one", F.lit(1)), by, on, "_one"), by, gap), least)
    inside = point_in_interval(df, spans.select(*by, "start", "stop"), by, ["start"]).where("r_start is not null").select(*by, "dx", "dy", F.col("r_start").alias("start"))
    net = inside.groupBy(*by, "start").agg(F.round(F.sum("dx"), 6).alias("net_x"), F.round(F.sum("dy"), 6).alias("net_y"))
    return spans.select(*by, "start", "stop").join(net, [*by, "start"])


def drop_covered(items: DataFrame, by: list[str], key: str, chunk: float | None = None) -> DataFrame:
    """Items without media go where others cover every part of them; then, in order of (start, media first), an item that
    overlaps the one kept before it goes. The first rule is counts of open items between edges, without pairs; the second
    takes `chunk` seconds of a recording in one task. An item that stops before it starts counts as empty; an empty one is
    covered if another holds its start."""
    stop = F.when(F.col("stop") < F.col("start"), F.col("start")).otherwise(F.col("stop"))
    ends = items.select(*by, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(stop.alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*by, "x.*")
    ends = ends.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("t")
    ends = ends.withColumn("open", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("alone", (F.col("open") == 1).cast("long"))
    ends = ends.select(*by, "t", "open", F.coalesce(F.sum("alone").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    at = lambda c, t: ends.select(*by, F.col("t").alias(t), F.col("n").alias(f"_{c}"), F.col("open").alias(f"_{c}_open"))
    left = items.withColumn("_to", stop).join(at("start", "start"), [*by, "start"]).join(at("stop", "_to"), [*by, "_to"])
    left = left.where(F.col("media") | (F.col("_stop") > F.col("_start")) | ((F.col("_to") == F.col("start")) & (F.col("_start_open") == 0)))
    rows = left.select(*by, "start", "stop", (~F.col("media")).alias("plain"), key)
    found = fold_in_chunks(rows, by, ["start", "plain", key, "stop"], by_time("start", chunk), Covers("start", "stop", key), f"{key} {items.schema[key].dataType.simpleString()}")
    return items.join(found, [*by, key], "left_semi")


def merge_same_kind(spans: DataFrame, by: list[str], gap: float) -> DataFrame:
    """Neighbours in order of start that are of one kind and at most `gap` apart become one span with their extremes."""
    w = Window.partitionBy(*by).orderBy("start", "stop", "kind")
    d = spans.withColumn("_k", (~F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))).cast("int"))
    d = d.withColumn("_k", F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(*by, "_k").orderBy("start", "stop")
    reach = F.max("stop").over(v.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_n", F.coalesce(F.col("start") > reach + gap, F.lit(True)).cast("int")).withColumn("_g", F.sum("_n").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "kind", "_k", "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("spans")).drop("_k", "_g")


def span_groups(readings: DataFrame, by: list[str], schema_by: str, bridge: float, least: int) -> DataFrame:
    """Readings (start, stop, mask: element numbers) gathered in order: one joins the first group that ends at most `bridge`
    before it and shares at least `least` elements with all of that group's readings. No group reaches over a gap wider than
    the bridge after all readings before it, so the fold takes one stretch between such gaps at a time."""
    w = Window.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = readings.select(*by, "start", "stop", "mask", F.coalesce(F.col("start") > reach + bridge, F.lit(True)).cast("long").alias("_n"))
    cut = cut.withColumn("_n", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(group: dict) -> list[tuple]:
        found: list[list] = []
        open_: list[list] = []
        for start, stop, mask in zip(group["start"].tolist(), group["stop"].tolist(), map(set, group["mask"]), strict=True):
            open_ = [g for g in open_ if start <= g[1] + bridge]
            home = next((g for g in open_ if len(g[2] & mask) >= least), None)
            if home is None:
                open_.append([start, stop, mask, 1])
                found.append(open_[-1])
            else:
                home[0], home[1], home[2], home[3] = min(home[0], start), max(home[1], stop), home[2] & mask, home[3] + 1
        return [(a, b, sorted(m), n) for a, b, m, n in found]

    return in_groups(cut, [*by, "_n"], ["start", "stop"], run, "start double, stop double, held array<long>, readings long").drop("_n")


def note_spans(frames: DataFrame, by: list[str], schema_by: str, opens: float = 0.15, closes: float = 0.06, apart: float = 1.0, confirm: int = 2, least: float = 0.04, reach: float = 0.0215) -> DataFrame:
    """Sounding runs (a gate that opens and closes at shares of the key's peak level), cut where the pitch (hz, 0: none) stays
    `apart` semitones or more off its reference for `confirm` pitched rows: start, stop, median pitch and strength of each
    span of `least` seconds. A run's outer ends give way by `reach`, half of what a row stands for. The cut is a fold, over one run."""
    key, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("t")
    d = frames.select(*by, "t", "hz", "level").withColumn("_peak", F.max("level").over(key)).where("_peak > 1e-5").withColumn("_share", F.col("level") / F.col("_peak"))
    d = hysteresis_state(d, by, "_share", opens, closes)
    d = d.withColumn("_new", (F.col("open") & ~F.coalesce(F.lag("open").over(w), F.lit(False))).cast("long"))
    d = d.withColumn("run", F.sum("_new").over(_before(by))).where("open")

    def run(group: dict) -> list[tuple]:
        t, level = group["t"], group["level"]
        hz = np.asarray(group["hz"], float)
        hz = np.where(hz > 0, hz, np.nan)
        cuts, reference, off = [0], np.nan, 0
        for i, p in enumerate((np.log2(hz) * 12).tolist()):
            if p != p or reference != reference:
                reference, off = (reference if p != p else p), 0 if p != p else off
            elif abs(p - reference) < apart:
                off = 0
            else:
                off += 1
                if off >= confirm:
                    cuts.append(i - off + 1)
                    reference, off = p, 0
        out = []
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(t)])):
            start, stop = t[a] + (reach if k == 0 else 0), t[b - 1] - (reach if k == len(cuts) - 1 else 0)
            if stop - start >= least:
                pitched = hz[a:b][~np.isnan(hz[a:b])]
                out.append((round(start, 3), round(stop, 3), round(float(np.median(pitched)), 2) if len(pitched) else 0.0, round(min(level[a:b].max(), 1.0), 4)))
        return out

    return in_groups(d.select(*by, "run", "t", "hz", "level"), [*by, "run"], ["t"], run, "start double, stop double, hz double, strength double")
