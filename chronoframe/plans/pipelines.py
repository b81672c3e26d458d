"""Ready-made analyses built from the operators (I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import islands as I
from ..operators import joins as J
from ..operators import windows as W
from ..sources.catalog import written


def grid_trust(grid: DataFrame, by: list[str], group: str) -> DataFrame:
    """A grid row is trusted if its position is inside the modal group size (2 or more) and it is steady; refusals say why."""
    size = A.modal_size(grid, by, group).select(*by, F.col("size").alias("_size"))
    pos = F.row_number().over(Window.partitionBy(*by, group).orderBy("t"))
    g = W.steady_flags(grid, by).withColumn("pos", pos).join(size, by)
    why = F.array_compact(F.array(F.when((F.col("_size") < 2) | (F.col("pos") > F.col("_size")), "bar_position"), F.when(~F.col("steady"), "tempo")))
    return g.withColumn("refused", why).withColumn("trusted", F.size("refused") == 0).drop("_size")


def adaptive_threshold(curve: DataFrame, by: list[str], level: str, ceiling: float, held: float, scale: float, floor: float) -> DataFrame:
    """The ceiling where `held` seconds reach it, else a share of the level held that long, `floor` at least."""
    c = A.with_step(curve, by)
    reach = c.groupBy(*by).agg(F.sum(F.when(F.col(level) >= ceiling, F.col("step"))).alias("_over"))
    h = A.held_level(c, by, level, "step", held)
    return reach.join(h, by).select(*by, F.when(F.col("_over") >= held, F.lit(ceiling)).otherwise(F.greatest(F.lit(floor), scale * F.col("held"))).alias("threshold"))


def quiet_sections(curve: DataFrame, onsets: DataFrame, by: list[str], level: str, threshold: float, gap: float, burst: float, least: float, density: float) -> DataFrame:
    """Stretches between bursts of a curve, with the density of onsets, kept or the reason they are not."""
    spans = I.bursts(curve, by, level, threshold, gap, burst)
    totals = curve.groupBy(*by).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    s = I.complement(spans, totals, by, 0.0).withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy("start")))
    d = J.count_in(s, onsets, by, "id")
    return d.withColumn("reason", F.when(F.col("stop") - F.col("start") < least, "brief").when(F.col("density") < density, "sparse"))


def lead_changes(levels: DataFrame, grid: DataFrame, by: list[str], name: str, level: str, margin: float, least: float, snap: float) -> DataFrame:
    """Who leads when: the leading series by prominence, short runs folded, changes snapped to the grid."""
    lifted = W.prominence(levels.withColumnRenamed(name, "_n"), [*by, "_n"], level).withColumnRenamed("_n", name)
    r = I.leader_runs(W.leader(lifted, by, name, "lift", margin), by, least)
    w = Window.partitionBy(*by).orderBy("start")
    ch = r.select(*by, F.col("start").alias("t"), F.lag("leader").over(w).alias("was"), F.col("leader").alias("to"))
    return J.nearest_join(ch, grid, by, ["t"], within=snap).withColumn("at", F.coalesce("r_t", "t")).drop("r_t", "offset")


def correlate(items: DataFrame, grid: DataFrame, changes: DataFrame | None, spans: DataFrame | None, by: list[str], key: str, chunk: float | None = None) -> DataFrame:
    """One row per item: signed offset to the nearest grid row, state, span it starts in, whether it opens, whether it is
    stranded. An absent side gives null columns, never zero. chunk: seconds of a recording that meet in one task."""
    near = J.out_of_reach(items.withColumn("start", F.col("t")), grid, by, chunk).drop("r_t", "r_spacing")
    near = W.opening_flag(near.withColumn("stop", F.col("t") + F.col("seconds")), by)
    near = J.state_asof(near, changes, by, chunk) if changes is not None else near.withColumn("state", F.lit(None).cast("string"))
    if spans is None:
        return near.withColumn("section", F.lit(None).cast("long"))
    s = spans.select(*by, "start", F.coalesce("stop", F.lit(float("inf"))).alias("stop"), "section")
    return J.point_in_interval(near.drop("start", "stop"), s, by, ["section"], chunk).withColumnRenamed("r_section", "section")


def correlate_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Offsets of rows that neither open nor are stranded; both are counted apart."""
    o = F.when(~F.col("opens") & ~F.coalesce("stranded", F.lit(False)), F.round("offset", 3))
    return rows.withColumn("_o", o).groupBy(*by).agg(F.count("_o").alias("measured"), F.round(F.avg(F.abs("_o")), 3).alias("mean"), F.round(F.median(F.abs("_o")), 3).alias("median"), F.count_if(F.col("_o") < 0).alias("early"), F.count_if(F.col("opens")).alias("openings"), F.count_if(F.col("stranded")).alias("stranded"), F.count_if(F.col("section").isNull()).alias("outside"))


def correlate_all(items: DataFrame, grid: DataFrame, by: list[str], key: str, *, bars: DataFrame | None = None, transients: DataFrame | None = None, sections: DataFrame | None = None, changes: DataFrame | None = None, deltas: DataFrame | None = None, graphics: DataFrame | None = None, samples: DataFrame | None = None, reach: float = 1.0, near: float = 0.5, guard: float = 0.0, width: float = 60.0) -> DataFrame:
    """One row per item (t, seconds) against everything known of its recording. An absent side gives nulls, never zeros.

    grid (t, trusted): offset to the nearest row, in_grid if that is trusted and in reach; stranded if it is farther than
    `reach` times the median gap around it. bars (t, bar, in_group): map_bar, in_group, bar_offset. transients (t):
    transient_offset. sections (start, stop or null, section): the one the item starts in. changes (t, was, to): the state,
    before the first change what that changes from. deltas (t, delta, jump): those within `near`, null where unread.
    graphics (start, stop, kind): whether the item starts strictly inside one, by guard, a card before others. samples (t,
    sharpness, exposure, clipped, stability): medians and worst over the item, and how many. Changes also split each item by
    state: most is the state with most of its seconds. The sides that are points meet the items in one exchange; those that
    are spans or samples meet them in buckets of `width`; what the first exchange gives is written to the shared folder, as all
    of these read it."""
    null = lambda kind: F.lit(None).cast(kind)
    w = Window.partitionBy(*by).orderBy("t")
    g = grid.withColumn("_gap", F.lead("t").over(w) - F.col("t"))
    g = g.withColumn("_wide", F.percentile("_gap", F.lit(0.5)).over(w.rowsBetween(-4, 4)))
    sides = {"grid": (g, ["trusted", "_wide"])}
    sides |= {"bars": (bars, ["bar", "in_group"])} if bars is not None else {}
    sides |= {"hits": (transients, [])} if transients is not None else {}
    sides |= {"sect": (sections.withColumn("t", F.col("start")), ["stop", "section"])} if sections is not None else {}
    sides |= {"change": (changes, ["was", "to"]), "held": (changes.where("to is not null"), ["to"])} if changes is not None else {}
    sides |= {"pic": (deltas, ["delta", "jump"])} if deltas is not None else {}
    r = W.opening_flag(items.withColumns({"start": F.col("t"), "stop": F.col("t") + F.col("seconds")}), by)
    r = J.multi_asof(r, sides, by).withColumn("_g", J.nearer("grid"))
    offset, wide = F.col("t") - F.col("_g.t"), F.col("_g._wide")
    r = r.withColumns({"offset": offset, "stranded": F.coalesce((wide > 0) & (F.abs(offset) > reach * wide), F.lit(False))})
    r = r.withColumn("in_grid", F.coalesce(F.col("_g.trusted"), F.lit(False)) & ~F.col("stranded"))
    b = J.nearer("bars") if bars is not None else None
    r = r.withColumns({"map_bar": b["bar"], "in_group": b["in_group"], "bar_offset": F.col("t") - b["t"]} if bars is not None else {"map_bar": null("long"), "in_group": null("long"), "bar_offset": null("double")})
    r = r.withColumn("transient_offset", F.col("t") - J.nearer("hits")["t"] if transients is not None else null("double"))
    r = r.withColumn("section", F.when(F.coalesce(F.col("t") < F.col("sect_back.stop"), F.col("sect_back").isNotNull()), F.col("sect_back.section")) if sections is not None else null("long"))
    if changes is not None:
        first = F.when(F.col("change_back").isNull(), F.col("change_next.was"))
        opening = changes.groupBy(*by).agg(F.min_by("was", "t").alias("_first"))
        r = r.join(opening, by, "left").withColumn("state", F.coalesce("held_back.to", first, "_first")).drop("_first")
    else:
        r = r.withColumn("state", null("string"))
    p = F.when(F.abs(F.col("t") - J.nearer("pic")["t"]) <= near, J.nearer("pic")) if deltas is not None else None
    r = r.withColumns({"delta": p["delta"], "jump": p["jump"]} if deltas is not None else {"delta": null("double"), "jump": null("boolean")})
    r = r.drop("_g", *(f"{n}_{side}" for n in sides for side in ("back", "next")))
    r = written(r, "items")
    lengths = r.select(*by, key, "start", "stop")
    r = J.straddle_join(r, graphics, by, key, width, guard).withColumnRenamed("kind", "super_kind")
    if samples is not None:
        aggs = [F.median("sharpness").alias("sharpness"), F.median("exposure").alias("exposure"), F.max("clipped").alias("clipped"), F.min("stability").alias("stability")]
        q = J.range_agg(lengths, samples.select(*by, "t", "sharpness", "exposure", "clipped", "stability"), by, key, width, aggs).withColumnRenamed("n", "samples").drop("start", "stop")
        r = r.join(q, [*by, key], "left")
    else:
        r = r.withColumns({c: null("double") for c in ("sharpness", "exposure", "clipped", "stability")}).withColumn("samples", F.lit(0).cast("long"))
    if changes is None:
        return r.withColumn("most", null("string"))
    held = changes.where("to is not null").select(*by, F.col("t").alias("start"), F.coalesce(F.lead("t").over(w), F.lit(float("inf"))).alias("stop"), F.col("to").alias("label"))
    head = changes.groupBy(*by).agg(F.min_by("was", "t").alias("label"), F.min(F.when(F.col("to").isNotNull(), F.col("t"))).alias("stop")).where("label is not null")
    ends = items.groupBy(*by).agg(F.min("t").alias("_from"), F.max(F.col("t") + F.col("seconds")).alias("_to"))
    spans = held.unionByName(head.select(*by, F.lit(float("-inf")).alias("start"), F.coalesce("stop", F.lit(float("inf"))).alias("stop"), "label")).join(ends, by)
    spans = spans.select(*by, F.greatest("start", "_from").alias("start"), F.least("stop", "_to").alias("stop"), "label").where("start < stop")
    most = J.overlap_split(lengths, spans, by, key, width).where("verdict").select(*by, key, F.col("label").alias("most"))
    return r.join(most, [*by, key], "left")


def correlate_all_summary(rows: DataFrame, by: list[str], places: int = 3) -> DataFrame:
    """Of correlate_all: offsets of items that don't open and stand in the grid; openings, items of a refused grid and stranded
    ones counted apart; offsets to bars without regard to the grid; unread steps, straddles and items without samples."""
    cut = ~F.col("opens")
    o, b = F.when(cut & F.col("in_grid"), F.round("offset", 3)), F.when(cut, F.round("bar_offset", 3))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.withColumns({"_o": o, "_b": b}).groupBy(*by).agg(
        F.count("*").alias("items"), F.count("_o").alias("measured"), F.round(F.avg(F.abs("_o")), places).alias("mean"), F.round(F.median(F.abs("_o")), places).alias("median"), n(F.col("_o") < 0).alias("early"), n(F.col("opens")).alias("openings"),
        n(cut & ~F.col("in_grid") & ~F.col("stranded")).alias("gated"), n(cut & F.col("stranded")).alias("stranded"), F.round(F.avg(F.abs("_b")), places).alias("bar_mean"), n(cut & (F.col("in_group") == 1)).alias("on_group"),
        F.count_if(F.col("section").isNull()).alias("outside"), F.count_if(F.col("delta").isNull()).alias("unread"), n(F.col("straddles")).alias("straddles"), F.count_if(F.col("samples") == 0).alias("unsampled"),
    )


def rhythm(items: DataFrame, by: list[str]) -> DataFrame:
    """Variation of lengths, longest alternation and monotone stretch, and whether it all reads metronomic: the alternation
    covers more than 0.8 of the cuts and the lengths are mechanical with it, by one bin of more than 0.6, a variation under
    0.35 or a monotone stretch over more than 0.6 of the cuts. What can't be read doesn't count against."""
    cv = items.groupBy(*by).agg(F.round(A.cv("seconds"), 4).alias("cv"), F.count("*").alias("n"))
    alt = W.alternation_run(items, by, "clip").withColumnsRenamed({"run": "alternation", "share": "alternation_share"})
    mono = W.monotone_run(items, by, "seconds").withColumnRenamed("run", "monotone")
    u = A.uniformity(items.withColumn("h", F.col("seconds") / 3600), by, "h").select(*by, "fullest", F.col("share").alias("fullest_share"))
    r = cv.join(alt, by).join(mono, by).join(u, by).withColumn("ramp_share", F.when(F.col("n") > 1, F.round(F.col("monotone") / (F.col("n") - 1), 4)).otherwise(0.0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return r.withColumn("metronomic", yes(F.col("alternation_share") > 0.8) & (yes(F.col("fullest_share") > 0.6) | yes(F.col("cv") < 0.35) | yes(F.col("ramp_share") > 0.6)))


def gears(items: DataFrame, levels: DataFrame, by: list[str], width: float) -> DataFrame:
    """Items per level tercile of the window their start lands in: rate per hour of window time, and short ones."""
    w = W.terciles(levels, by, "level").select(*by, "t", "tercile")
    time = A.with_step(w, by).groupBy(*by, "tercile").agg(F.sum(F.least("step", F.lit(width))).alias("_s"))
    hit = J.window_at(items, w, by, width, ["tercile"]).where("r_tercile is not null").groupBy(*by, F.col("r_tercile").alias("tercile")).agg(F.count("*").alias("n"), F.count_if(F.col("seconds") < 3600).alias("short"))
    g = time.join(hit, [*by, "tercile"], "left").fillna(0, ["n", "short"])
    return g.select(*by, "tercile", "n", "short", F.when(F.col("_s") > 0, F.round(3600 * F.col("n") / F.col("_s"), 4)).alias("rate"))


def gear_verdict(items: DataFrame, levels: DataFrame, by: list[str], width: float, short: float) -> DataFrame:
    """Per key, over the windows of `width` that touch the cut: items outside of them, items a minute of loud and of quiet
    windows, their ratio (null if nothing is cut in quiet), short items, how many of these and what share fall in loud ones,
    and one_speed: a ratio under 1.3 with a variation of lengths under 0.65. Keys without windows give none."""
    cut = items.groupBy(*by).agg(F.min("t").alias("_from"), F.max(F.col("t") + F.col("seconds")).alias("_to"), F.round(A.cv("seconds"), 4).alias("cv"))
    near = levels.join(cut, by).where((F.col("t") < F.col("_to")) & (F.col("t") + width > F.col("_from"))).select(*by, "t", "level")
    w = W.terciles(near, by, "level").select(*by, "t", "tercile")
    span = w.groupBy(*by).agg(F.max("t").alias("_last"), *(F.count_if(F.col("tercile") == g).alias(f"_{g}") for g in ("quiet", "loud")))
    hit = J.asof_join(items.select(*by, "t", "seconds"), w, by, ["tercile"]).join(span, by)
    gear = F.when(F.col("t") < F.col("_last") + width, F.col("r_tercile"))
    n = hit.withColumn("_g", gear).groupBy(*by).agg(
        F.count_if(F.col("_g").isNull()).alias("outside"), F.count_if(F.col("_g") == "loud").alias("_nl"), F.count_if(F.col("_g") == "quiet").alias("_nq"),
        F.count_if(F.col("_g").isNotNull() & (F.col("seconds") < short)).alias("short"), F.count_if((F.col("_g") == "loud") & (F.col("seconds") < short)).alias("short_loud"),
    )
    r = n.join(span, by).join(cut, by)
    rate = lambda k, w: F.when(F.col(w) > 0, F.round(F.col(k) / (F.col(w) * width / 60), 4))
    r = r.withColumns({"loud": rate("_nl", "_loud"), "quiet": rate("_nq", "_quiet")}).withColumn("ratio", F.when(F.col("quiet") > 0, F.round(F.col("loud") / F.col("quiet"), 4)))
    one = F.coalesce((F.col("ratio") < 1.3) & (F.col("cv") < 0.65), F.lit(False))
    return r.select(*by, "outside", "loud", "quiet", "ratio", "short", "short_loud", F.when(F.col("short") > 0, F.round(F.col("short_loud") / F.col("short"), 4)).alias("short_share"), one.alias("one_speed"))


def quality_catalog(samples: DataFrame, by: list[str], floors: dict[str, float], index: str, gap: int = 1) -> DataFrame:
    """Windows of bad samples: extent, count, reasons and the worst severity."""
    from ..functions.columns import floor_misses, severity

    three = [F.col(c) for c in ("sharpness", "clipped", "stability")]
    s = samples.withColumns({"_m": floor_misses(*three, floors), "_v": severity(*three, floors)})
    aggs = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_m")))), ",").alias("reasons"), F.round(F.max("_v"), 6).alias("severity")]
    return I.index_runs(s, by, index, F.size("_m") > 0, gap, aggs)


def quality_header(samples: DataFrame, by: list[str], floors: dict[str, float]) -> DataFrame:
    """The whole stretch as one block: samples, those unusable and their share, the summary, its verdict."""
    n = samples.groupBy(*by).agg(F.count("*").alias("samples"))
    s = n.join(A.stretch_summary(samples, by, floors), by)
    return s.withColumn("unusable_share", F.round(F.col("failed") / F.col("samples"), 4))


def segment_table(cuts: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Segments between cuts: count, rate per hour, lengths."""
    s = I.segments_from_cuts(cuts, bounds, by).withColumn("seconds", F.col("stop") - F.col("start"))
    return s.groupBy(*by).agg(F.count("*").alias("segments"), F.round(3600 * F.count("*") / F.sum("seconds"), 6).alias("per_hour"), F.round(F.avg("seconds"), 3).alias("mean"), F.round(F.median("seconds"), 3).alias("median"))


def segment_histogram(cuts: DataFrame, bounds: DataFrame, by: list[str], unit: float = 1.0) -> DataFrame:
    """How many segments have a length, in `unit` seconds, of each bin."""
    s = I.segments_from_cuts(cuts, bounds, by).withColumn("length", (F.col("stop") - F.col("start")) / unit)
    return A.binned_histogram(s, by, "length")


def event_rank(events: DataFrame, by: list[str], key: str, tolerance: float, spacing: float, k: int) -> DataFrame:
    """Events scored with the bonus for other kinds nearby, best first, spaced."""
    c = J.coincidence(events, by, tolerance).withColumn("score", F.round(F.col("value") / 100 + F.col("bonus"), 6))
    return I.spaced_top_k(c, by, key, "score", spacing, k)


def threshold_sweep(curve: DataFrame, truth: DataFrame, by: list[str], level: str, thresholds: list[float], gap: float, burst: float, tolerance: float) -> DataFrame:
    """Burst starts at every threshold scored against the truth; the thresholds are a column, so all run at once."""
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    c, t = curve.select("*", each), truth.select("*", each)
    spans = I.min_length(I.merge_gaps(I.runs(c, [*by, "threshold"], F.col(level) >= F.col("threshold"), level), [*by, "threshold"], gap), burst)
    return J.match_truth(spans.select(*by, "threshold", F.col("start").alias("t")), t, [*by, "threshold"], tolerance)
