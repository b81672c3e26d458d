"""Nearest, as-of, interval and reference joins.

As-of joins are one union and one window over the recording, so a single exchange and no pair is formed; with
`chunk` a long recording is cut into stretches of time, each seeded with the last row before it, so that one key
spreads over many tasks. Interval joins meet on buckets of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import nearest_of_all


def _both(left: DataFrame, right: DataFrame, by: list[str], cols: list[str], chunk: float | None, forward: bool = True) -> tuple[DataFrame, list[str]]:
    """Left and right rows in one table, the right ones with their columns in a struct _r."""
    payload = F.struct(F.col("t").alias("t"), *(F.col(c) for c in cols if c != "t"))
    r = right.select(*by, "t", payload.alias("_r"))
    both = left.withColumn("_left", F.lit(True)).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    if chunk is None:
        return both, by
    both = both.withColumn("_chunk", F.floor(F.col("t") / chunk))
    edges = both.groupBy(*by, "_chunk").agg(F.max_by("_r", F.when(~F.col("_left"), F.col("t"))).alias("_last"), F.min_by("_r", F.when(~F.col("_left"), F.col("t"))).alias("_first"))
    w = Window.partitionBy(*by).orderBy("_chunk")
    before = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    for seed in (edges.select(*by, "_chunk", before.alias("_r")), edges.select(*by, "_chunk", after.alias("_r"))):
        seed = seed.where("_r is not null").select(*by, "_chunk", "_r", F.col("_r.t").alias("t"), F.lit(False).alias("_left"))
        both = both.unionByName(seed, allowMissingColumns=True)
    return both, [*by, "_chunk"]


def _matched(left: DataFrame, right: DataFrame, by: list[str], cols: list[str], chunk: float | None, strict: bool = False) -> DataFrame:
    """left with _back and _next: the last right row at or before t, the first at or after it (after it, if strict)."""
    both, keys = _both(left, right, by, cols, chunk)
    back = Window.partitionBy(*keys).orderBy("t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("t", F.col("_left").asc() if strict else F.col("_left").desc()).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"_back": F.last("_r", ignorenulls=True).over(back), "_next": F.first("_r", ignorenulls=True).over(ahead)})
    return both.where("_left").select(*left.columns, "_back", "_next")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], cols: list[str], forward: bool = False, strict: bool = False, chunk: float | None = None, prefix: str = "r_") -> DataFrame:
    """left with the columns of the last right row at or before t (forward: the first at or after; strict: after)."""
    side = "_next" if forward else "_back"
    m = _matched(left, right, by, cols, chunk, strict)
    return m.select(*left.columns, *(F.col(f"{side}.{c}").alias(prefix + c) for c in cols))


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], cols: list[str], within: float | None = None, chunk: float | None = None, prefix: str = "r_") -> DataFrame:
    """left with the nearest right row in time, the earlier one on a tie, and the signed offset (negative: early); null beyond `within`."""
    m = _matched(left, right, by, cols, chunk)
    early = F.col("_next").isNull() | (F.col("t") - F.col("_back.t") <= F.col("_next.t") - F.col("t"))
    m = m.withColumn("_n", F.when(F.col("_back").isNotNull() & early, F.col("_back")).otherwise(F.col("_next")))
    offset = F.col("t") - F.col("_n.t")
    if within is not None:
        m = m.withColumn("_n", F.when(F.abs(offset) <= within, F.col("_n")))
    return m.select(*left.columns, *(F.col(f"_n.{c}").alias(prefix + c) for c in cols), offset.alias("offset"))


def multi_asof(left: DataFrame, sides: dict[str, tuple[DataFrame, list[str]]], by: list[str]) -> DataFrame:
    """left with, for each side, the last row at or before t and the first at or after it, as structs <name>_back and
    <name>_next of t and the side's columns. All sides stand in one union with a typed payload each, so a recording is
    exchanged once however many sides there are, and sorted once either way."""
    kinds = {name: F.struct(F.col("t").alias("t"), *(F.col(c) for c in cols)) for name, (_, cols) in sides.items()}
    typed = {name: df.select(kinds[name].alias("x")).schema["x"].dataType for name, (df, _) in sides.items()}
    own = F.struct(*(F.col(c) for c in left.columns))
    own_type = left.select(own.alias("x")).schema["x"].dataType

    def rows(df: DataFrame, name: str | None) -> DataFrame:
        payload = [(kinds[n] if n == name else F.lit(None).cast(t)).alias(n) for n, t in typed.items()]
        return df.select(*by, "t", F.lit(name is None).alias("_left"), (own if name is None else F.lit(None).cast(own_type)).alias("_own"), *payload)

    both = rows(left, None)
    for name, (df, _) in sides.items():
        both = both.union(rows(df.where("t is not null"), name))
    until = lambda *order: Window.partitionBy(*by).orderBy(*order, "_left").rowsBetween(Window.unboundedPreceding, 0)
    back, ahead = until("t"), until(F.desc("t"))
    both = both.withColumns({f"{n}_back": F.last(n, ignorenulls=True).over(back) for n in sides})
    both = both.withColumns({f"{n}_next": F.last(n, ignorenulls=True).over(ahead) for n in sides})
    return both.where("_left").select("_own.*", *(f"{n}_{w}" for n in sides for w in ("back", "next")))


def nearer(name: str) -> Column:
    """Of a side of multi_asof the row nearest to t, the earlier one on a tie."""
    back, ahead = F.col(f"{name}_back"), F.col(f"{name}_next")
    return F.when(ahead.isNull() | (F.col("t") - back["t"] <= ahead["t"] - F.col("t")), back).otherwise(ahead)


def state_asof(left: DataFrame, changes: DataFrame, by: list[str], chunk: float | None = None) -> DataFrame:
    """State at t from change rows (t, was, to): before the first change what that changes from; a null `to` keeps the state."""
    held = asof_join(left, changes.where("to is not null"), by, ["to"], chunk=chunk)
    first = changes.groupBy(*by).agg(F.min_by("was", "t").alias("_first"), F.min("t").alias("_opens"))
    return held.join(first, by, "left").withColumn("state", F.coalesce("r_to", "_first")).drop("r_to", "_first", "_opens")


def window_at(left: DataFrame, windows: DataFrame, by: list[str], width: float, cols: list[str]) -> DataFrame:
    """The window that t lies in; windows follow each other, the last is `width` long; null outside."""
    w = windows.withColumn("_end", F.coalesce(F.lead("t").over(Window.partitionBy(*by).orderBy("t")), F.col("t") + width))
    hit = asof_join(left, w, by, [*cols, "_end"])
    inside = F.col("t") < F.col("r__end")
    return hit.select(*left.columns, *(F.when(inside, F.col(f"r_{c}")).alias(f"r_{c}") for c in cols))


def forward_or_nearest(left: DataFrame, grid: DataFrame, by: list[str], tolerance: float, until: Column | None = None) -> DataFrame:
    """First grid row at or after t and not after `until`; else the nearest within tolerance; else t itself, snapped false."""
    m = _matched(left, grid, by, ["t"], None)
    ahead = F.col("_next.t") if until is None else F.when(F.col("_next.t") <= until, F.col("_next.t"))
    back, nxt, t = F.col("_back.t"), F.col("_next.t"), F.col("t")
    near = F.when(back.isNotNull() & (nxt.isNull() | (t - back <= nxt - t)), back).otherwise(nxt)
    near = F.when(F.abs(near - t) <= tolerance, near)
    at = F.coalesce(ahead, near)
    return m.select(*left.columns, F.coalesce(at, t).alias("at"), at.isNotNull().alias("snapped"))


def point_in_interval(left: DataFrame, spans: DataFrame, by: list[str], cols: list[str], chunk: float | None = None) -> DataFrame:
    """The span (start, stop) with start <= t < stop; spans don't overlap; null between them."""
    s = spans.withColumn("t", F.col("start"))
    hit = asof_join(left, s, by, [*cols, "stop"], chunk=chunk)
    inside = F.col("t") < F.col("r_stop")
    return hit.select(*left.columns, *(F.when(inside, F.col(f"r_{c}")).alias(f"r_{c}") for c in cols))


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], width: float, guard: float = 0.0) -> DataFrame:
    """All pairs of a (start, stop) and b (b_start, b_stop) that overlap. Both meet on buckets of `width`; each pair once."""
    deal = lambda df, s, e, name: df.withColumn(f"_{name}", F.floor(F.col(s) / width)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    pairs = deal(a, "start", "stop", "a").join(deal(b, "b_start", "b_stop", "b"), [*by, "_bucket"])
    once = F.col("_bucket") == F.greatest("_a", "_b")
    return pairs.where(once & (F.col("start") + guard < F.col("b_stop")) & (F.col("b_start") + guard < F.col("stop"))).drop("_a", "_b", "_bucket")


def points_in_spans(points: DataFrame, spans: DataFrame, by: list[str], width: float, guard: float | None = None) -> DataFrame:
    """All pairs of a point and a span (start, stop) that holds it: start <= t < stop, or strictly inside by guard."""
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    pairs = points.withColumn("_bucket", F.floor(F.col("t") / width)).join(s, [*by, "_bucket"]).drop("_bucket")
    t = F.col("t")
    if guard is None:
        return pairs.where((F.col("start") <= t) & (t < F.col("stop")))
    return pairs.where((F.col("start") + guard < t) & (t < F.col("stop") - guard))


def straddle_join(points: DataFrame, spans: DataFrame | None, by: list[str], key: str, width: float, guard: float, first_kind: str = "card") -> DataFrame:
    """Whether a point lies strictly inside a span, and of which kind: first_kind wins, else the earliest span; no table: nulls."""
    if spans is None:
        return points.withColumns({"straddles": F.lit(None).cast("boolean"), "kind": F.lit(None).cast("string")})
    hits = points_in_spans(points.select(*by, key, "t"), spans.select(*by, "start", "stop", "kind"), by, width, guard)
    best = hits.groupBy(*by, key).agg(F.min_by("kind", F.struct((F.col("kind") != first_kind).alias("p"), "start", "kind")).alias("kind"))
    return points.join(best, [*by, key], "left").withColumn("straddles", F.col("kind").isNotNull())


def overlap_split(items: DataFrame, spans: DataFrame, by: list[str], key: str, width: float) -> DataFrame:
    """Seconds of each item with each label, and the verdict: the label with most, the first played on a tie."""
    pairs = overlap_join(items.select(*by, key, "start", "stop"), spans.select(*by, F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), "label"), by, width)
    each = pairs.withColumn("s", F.least("stop", "b_stop") - F.greatest("start", "b_start")).groupBy(*by, key, "label").agg(F.round(F.sum("s"), 3).alias("seconds"), F.min(F.greatest("start", "b_start")).alias("first"))
    w = Window.partitionBy(*by, key).orderBy(F.desc("seconds"), "first", "label")
    return each.select("*", (F.row_number().over(w) == 1).alias("verdict")).drop("first")


def range_agg(items: DataFrame, samples: DataFrame, by: list[str], key: str, width: float, aggs: list[Column]) -> DataFrame:
    """Samples with start <= t < stop per item; none gives nulls and count 0, never a neighbour's."""
    hits = points_in_spans(samples, items.select(*by, key, "start", "stop"), by, width)
    return items.join(hits.groupBy(*by, key).agg(F.count("*").alias("n"), *aggs), [*by, key], "left").fillna(0, ["n"])


def max_overlap(left: DataFrame, right: DataFrame, by: list[str], key: str, right_key: str, width: float) -> DataFrame:
    """The right interval that holds most of the left one, the first on a tie; null if none overlaps."""
    pairs = overlap_join(left.select(*by, key, "start", "stop"), right.select(*by, right_key, F.col("start").alias("b_start"), F.col("stop").alias("b_stop")), by, width)
    over = F.least("stop", "b_stop") - F.greatest("start", "b_start")
    best = pairs.groupBy(*by, key).agg(F.max_by(right_key, F.struct(over.alias("o"), (-F.col("b_start")).alias("s"))).alias(right_key))
    return left.join(best, [*by, key], "left")


def clip_to_window(items: DataFrame, start: Column, duration: float) -> DataFrame:
    """Items in window time, clipped, those outside dropped; whole tells those that lie inside."""
    a, b = F.col("start") - start, F.col("stop") - start
    return items.where((b > 0) & (a < duration)).withColumns({"in_at": F.greatest(a, F.lit(0.0)), "in_end": F.least(b, F.lit(float(duration))), "whole": (a >= 0) & (b <= duration)})


def resolve_unique(refs: DataFrame, targets: DataFrame, on: list[str], target_key: str) -> DataFrame:
    """The one target of each reference; matches counts, the key only where it is one."""
    found = targets.groupBy(*on).agg(F.count("*").alias("matches"), F.min(target_key).alias("_k"))
    return refs.join(found, on, "left").fillna(0, ["matches"]).withColumn(target_key, F.when(F.col("matches") == 1, F.col("_k"))).drop("_k")


def keep_named(df: DataFrame, names: DataFrame, on: str) -> DataFrame:
    return df.join(names, on, "left_semi")


def anchored(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Child position: the parent's start + offset; null for an unknown parent."""
    return children.join(parents.select(*on, F.col("start").alias("_p")), on, "left").withColumn("at", F.col("_p") + F.col("offset")).drop("_p")


def undeclared(uses: DataFrame, declared: DataFrame, on: str) -> DataFrame:
    return uses.join(declared, on, "left_anti")


def clearance(spans: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """Distance from a span's end to the first point after it."""
    ends = spans.withColumn("t", F.col("stop"))
    return asof_join(ends, points, by, ["t"], forward=True, strict=True).withColumn("clearance", F.col("r_t") - F.col("stop")).drop("r_t", "t")


def coincidence(events: DataFrame, by: list[str], tolerance: float, kind: str = "kind") -> DataFrame:
    """How many other kinds stand within the tolerance of a row, and the bonus for them."""
    w = Window.partitionBy(*by).orderBy(F.round(F.col("t") * 1_000_000).cast("long")).rangeBetween(-round(tolerance * 1_000_000), round(tolerance * 1_000_000))
    others = F.size(F.array_except(F.collect_set(kind).over(w), F.array(kind)))
    return events.withColumn("agree", others).withColumn("bonus", F.least(0.2 * F.col("agree"), F.lit(0.4)))


def clock_align(items: DataFrame, by: list[str], name: str, fps: float) -> DataFrame:
    """Seconds on a recording's clock: frame zero is start - source_in of the item of that name, else of the first item."""
    pick = F.struct((F.col("clip") != name).alias("other"), "start")
    zero = items.groupBy(*by).agg(F.min_by(F.col("start") - F.col("source_in"), pick).alias("zero"), F.bool_or(F.col("clip") == name).alias("matched"))
    return items.join(zero, by).withColumn("clock", (F.col("start") - F.col("zero")) / fps)


def single_anchor(items: DataFrame, by: list[str], value: str) -> DataFrame:
    """The one value all items agree on, else null."""
    return items.groupBy(*by).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def carry_annotations(marks: DataFrame, old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Marks moved by the difference of the two anchors of their document; no shared anchor: moved is null, with a reason."""
    both = old.select(*on, F.col("zero").alias("_old")).join(new.select(*on, F.col("zero").alias("_new")), on)
    m = marks.join(both, on, "left").withColumn("moved", F.col("frame") + F.col("_new") - F.col("_old"))
    return m.withColumn("reason", F.when(F.col("moved").isNull(), "no shared anchor")).drop("_old", "_new")


def exists_near(left: DataFrame, points: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    return nearest_join(left, points, by, ["t"], within=tolerance).withColumn("near", F.col("r_t").isNotNull()).drop("r_t", "offset")


def count_in(spans: DataFrame, points: DataFrame, by: list[str], key: str) -> DataFrame:
    """Points with start <= t < stop, as the difference of two running counts, and their density per second."""
    p = points.select(*by, "t").withColumn("c", F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    p = p.groupBy(*by, "t").agg(F.max("c").alias("c"))
    edges = spans.select(*by, key, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("stop").alias("t"), F.lit(1).alias("sign")))).alias("x")).select(*by, key, "x.*")
    # points before an edge: right rows at the edge itself don't count, so they sort after it
    both, keys = _both(edges, p, by, ["c"], None)
    w = Window.partitionBy(*keys).orderBy("t", F.col("_left").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("n", F.coalesce(F.last("_r", ignorenulls=True).over(w)["c"], F.lit(0))).where("_left")
    n = at.groupBy(*by, key).agg(F.sum(F.col("sign") * F.col("n")).alias("n"))
    length = F.col("stop") - F.col("start")
    return spans.join(n, [*by, key]).withColumn("density", F.when(length > 0, F.col("n") / length).otherwise(0.0))


def covering(spans: DataFrame, items: DataFrame, by: list[str], key: str, item_key: str) -> DataFrame:
    """The first item that starts at or before a span and ends at or after it; found by the furthest end so far."""
    reach = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    i = items.select(*by, F.col("start").alias("t"), "stop", item_key).withColumn("_best", F.max_by(F.struct("stop", item_key), "stop").over(reach))
    m = asof_join(spans.withColumn("t", F.col("start")), i, by, ["_best"])
    ok = F.col("r__best.stop") >= F.col("stop")
    return m.withColumn(item_key, F.when(ok, F.col(f"r__best.{item_key}"))).drop("r__best", "t")


def snap_targets(targets: DataFrame, onsets: DataFrame, by: list[str], reach: float, early: float, fps: float) -> DataFrame:
    """Each target moved to the nearest onset within reach, then `early` seconds ahead onto a frame."""
    m = nearest_join(targets, onsets, by, ["t"], within=reach)
    return m.withColumn("snapped", F.floor(F.round((F.coalesce("r_t", "t") - early) * fps, 9)) / fps).drop("offset")


def match_truth(found: DataFrame, truth: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Per key: truths, those matched within tolerance, found points near no truth, and the worst error if all matched."""
    t = nearest_join(truth.select(*by, "t"), found.select(*by, "t"), by, ["t"])
    err = F.abs("offset")
    per = t.groupBy(*by).agg(F.count("*").alias("truths"), F.count_if(err <= tolerance).alias("matched"), F.max(err).alias("_worst"))
    f = nearest_join(found.select(*by, "t"), truth.select(*by, "t"), by, ["t"], within=tolerance).groupBy(*by).agg(F.count_if(F.col("r_t").isNull()).alias("invented"))
    return per.join(f, by, "left").fillna(0, ["invented"]).withColumn("worst", F.when(F.col("matched") == F.col("truths"), F.round("_worst", 3))).drop("_worst")


def section_rollup(items: DataFrame, spans: DataFrame, by: list[str], key: str) -> DataFrame:
    """Items whose start falls in each section: count, rate per minute, length statistics and short ones."""
    hit = point_in_interval(items, spans.withColumn("stop", F.coalesce("stop", F.lit(float("inf")))), by, [key, "start"]).where(f"r_{key} is not null")
    s = F.col("seconds")
    return hit.groupBy(*by, F.col(f"r_{key}").alias(key)).agg(F.count("*").alias("n"), F.round(F.avg(s), 3).alias("mean"), F.round(F.median(s), 3).alias("median"), F.round(F.min(s), 3).alias("shortest"), F.round(F.max(s), 3).alias("longest"), F.count_if(s < 3600).alias("short"))


def words_in_segment(words: DataFrame, segs: DataFrame, by: list[str], width: float = 64.0) -> DataFrame:
    """Words (w_in, w_out) that overlap a segment (s_in, s_out): wholly inside, or clipped where it opens or closes. Both meet
    on buckets of `width` in time, not on whole keys."""
    w = words.withColumns({"start": F.col("w_in"), "stop": F.col("w_out")})
    g = segs.withColumns({"b_start": F.col("s_in"), "b_stop": F.col("s_out")})
    m = overlap_join(w, g, by, width).drop("start", "stop", "b_start", "b_stop")
    return m.withColumn("clipped", F.when(F.col("w_in") < F.col("s_in"), "opens").when(F.col("w_out") > F.col("s_out"), "closes"))


def out_of_reach(left: DataFrame, grid: DataFrame, by: list[str], chunk: float | None = None) -> DataFrame:
    """Whether the nearest grid row is farther than the median gap of the grid around it."""
    w = Window.partitionBy(*by).orderBy("t")
    gap = F.lead("t").over(w) - F.col("t")
    g = grid.select(*by, "t").withColumn("gap", gap)
    g = g.withColumn("spacing", F.percentile("gap", F.lit(0.5)).over(w.rowsBetween(-4, 4)))
    return nearest_join(left, g, by, ["t", "spacing"], chunk=chunk).withColumn("stranded", F.abs("offset") > F.col("r_spacing"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)


def _centred(v: Column) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.zip_with(v, F.array_repeat(mean, F.size(v)), lambda x, y: x - y)


def nearest_vector(queries: DataFrame, candidates: DataFrame, on: list[str], key: str, pivots: int = 64) -> DataFrame:
    """Candidate most like each query, never itself, at the same aligned key, with the margin to the worst; of equal ones the
    smallest. With no aligned key every candidate counts, found through pivots."""
    if not on:
        return nearest_of_all(queries, candidates, key, pivots).drop("met")
    unit = lambda df: df.withColumn("vec", _centred(F.col("vec"))).withColumn("_len", F.sqrt(_dot(F.col("vec"), F.col("vec"))))
    q, c = unit(queries), unit(candidates).select(*on, F.col(key).alias("pick"), F.col("vec").alias("_c"), F.col("_len").alias("_clen"))
    m = q.join(c, on).where(F.col(key) != F.col("pick"))
    m = m.select(*on, key, "pick", F.round(_dot(F.col("vec"), F.col("_c")) / (F.col("_len") * F.col("_clen")), 5).alias("score"))
    return m.groupBy(*on, key).agg(F.max_by(F.struct("pick", "score"), F.struct("score", -F.col("pick"))).alias("x"), (F.max("score") - F.min("score")).alias("margin")).select(*on, key, "x.*", F.round("margin", 5).alias("margin"))


def reconcile(expected: DataFrame, landed: DataFrame, on: list[str]) -> DataFrame:
    """Expected items against landed ones of the same place: misplaced, source differs, or ok; an unreported source is ok."""
    got = landed.select(*on, F.col("source").alias("_s"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "misplaced").when(F.col("_s") != F.col("source"), "source differs").otherwise("ok")
    return expected.join(got, on, "left").withColumn("status", status).drop("_s", "_there")
