"""Statistics over recordings. Empty groups give null, not 0; standard deviations are of the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import written

BINS = (("<2", 0, 2), ("2-4", 2, 4), ("4-8", 4, 8), ("8-15", 8, 15), ("15-30", 15, 30), (">30", 30, None))


def offset_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Measured, mean, median and largest absolute offset, and how many are early, late and on."""
    x, a = F.col(col), F.abs(col)
    r = lambda c: F.round(c, 3)
    return df.groupBy(*by).agg(F.count(x).alias("measured"), r(F.avg(a)).alias("mean"), r(F.median(a)).alias("median"), r(F.max(a)).alias("worst"), F.count_if(x < 0).alias("early"), F.count_if(x > 0).alias("late"), F.count_if(x == 0).alias("on"))


def histogram(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("string").alias("key")).agg(F.count("*").alias("n"))


def bin_label(x: Column) -> Column:
    label = F.when(x < BINS[0][2], BINS[0][0])
    for name, _, high in BINS[1:]:
        label = label.when(x < high, name) if high else label.otherwise(name)
    return F.when(x.isNotNull(), label)


def binned_histogram(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Counts per half-open bin, every bin present."""
    x = bin_label(F.col(col))
    wide = df.groupBy(*by).agg(*(F.count_if(x == n).alias(n) for n, _, _ in BINS))
    return wide.unpivot(by, [n for n, _, _ in BINS], "bin", "n")


def length_summary(df: DataFrame, by: list[str], col: str) -> DataFrame:
    r = lambda c: F.round(c, 3)
    return df.groupBy(*by).agg(r(F.avg(col)).alias("mean"), r(F.median(col)).alias("median"), r(F.min(col)).alias("shortest"), r(F.max(col)).alias("longest"))


def usage(df: DataFrame, by: list[str], label: str, seconds: str) -> DataFrame:
    """Rows, seconds and share of all seconds per label; a null label is unlabelled."""
    each = df.groupBy(*by, F.coalesce(label, F.lit("unlabelled")).alias(label)).agg(F.count("*").alias("rows"), F.sum(seconds).alias("s"))
    total = F.sum("s").over(Window.partitionBy(*by))
    return each.select(*by, label, "rows", F.round("s", 3).alias("seconds"), F.when(total > 0, F.round(F.col("s") / total, 4)).alias("share"))


def spread(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(col).alias("covered"), F.count_if(F.col(col).isNull()).alias("outside"))


def cv(col: str) -> Column:
    """Population standard deviation over the mean; null when the mean is not positive."""
    return F.when(F.avg(col) > 0, F.stddev_pop(col) / F.avg(col))


def spread_ratio(col: str) -> Column:
    return F.when(F.min(col) > 0, F.max(col) / F.min(col))


def uniformity(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Fullest bin (the first on a tie), its share, and the variation of the values."""
    x = bin_label(F.col(col))
    counts = [F.count_if(x == n) for n, _, _ in BINS]
    best = F.array_max(F.array(*(F.struct(c.alias("n"), F.lit(-k).alias("k"), F.lit(b[0]).alias("bin")) for k, (c, b) in enumerate(zip(counts, BINS, strict=True)))))
    return df.groupBy(*by).agg(best.alias("b"), F.count(col).alias("n"), F.round(cv(col), 4).alias("cv")).select(*by, F.col("b.bin").alias("fullest"), F.when(F.col("n") > 0, F.round(F.col("b.n") / F.col("n"), 4)).alias("share"), "cv")


def quantile_summary(df: DataFrame, by: list[str], col: str) -> DataFrame:
    q = F.percentile(col, F.array(F.lit(0.1), F.lit(0.5)))
    return df.groupBy(*by).agg(F.round(F.min(col), 4).alias("low"), q.alias("q"), F.round(F.avg(col), 4).alias("mean"), F.round(F.max(col), 4).alias("high"), F.count_if(F.col(col).isNull()).alias("unread")).select(*by, "low", F.round(F.col("q")[0], 4).alias("p10"), F.round(F.col("q")[1], 4).alias("median"), "mean", "high", "unread")


def nearest_rank_spread(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Order statistics by rank, without interpolation."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {col})")
    return df.groupBy(*by).agg(F.min(col).alias("low"), at(0.05).alias("p05"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max(col).alias("high")).withColumn("ratio", F.when(F.col("p95") > 0, F.round(F.col("p05") / F.col("p95"), 6)))


def stretch_summary(df: DataFrame, by: list[str], floors: dict[str, float]) -> DataFrame:
    """Median sharpness, worst clipping and stability over a stretch, failures, and the verdict on those."""
    from ..functions.columns import floor_misses

    one = floor_misses(F.col("sharpness"), F.col("clipped"), F.col("stability"), floors)
    s = df.withColumn("_bad", F.size(one) > 0).groupBy(*by).agg(F.median("sharpness").alias("sharpness"), F.max("clipped").alias("clipped"), F.min("stability").alias("stability"), F.count_if("_bad").alias("failed"))
    return s.withColumn("misses", F.array_join(floor_misses(F.col("sharpness"), F.col("clipped"), F.col("stability"), floors), ","))


def misses(df: DataFrame, by: list[str], col: str, floor: float | None, id: str, below: bool = True) -> DataFrame | None:
    """Count and first 12 ids on the wrong side of a floor; None when no floor is named. Only 12 ids are kept per group."""
    if floor is None:
        return None
    bad = df.where(F.col(col) < floor if below else F.col(col) > floor)
    first = bad.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(id)))
    return first.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 12, F.col(id)))).alias("ids"))


def covered_length(df: DataFrame, by: list[str]) -> DataFrame:
    """Length of the union of intervals (start, stop)."""
    w = Window.partitionBy(*by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0.0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(w), F.col("start"))))
    return df.withColumn("_new", new).groupBy(*by).agg(F.round(F.sum("_new"), 3).alias("covered"))


def modal_size(df: DataFrame, by: list[str], group: str) -> DataFrame:
    """Most common group size (the first seen on a tie), its share, and whether the grid is committed to it."""
    sizes = df.groupBy(*by, group).agg(F.count("*").alias("size"), F.min("t").alias("t"))
    each = sizes.groupBy(*by, "size").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    best = each.groupBy(*by).agg(F.max_by("size", F.struct("n", (-F.col("first")).alias("f"))).alias("size"), F.max("n").alias("n"), F.sum("n").alias("groups"))
    return best.select(*by, "size", F.round(F.col("n") / F.col("groups"), 4).alias("share"), ((F.col("n") >= 0.8 * F.col("groups")) & (F.col("size") >= 2)).alias("committed"))


def tempo_gist(df: DataFrame, by: list[str]) -> DataFrame:
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t"))
    rate = F.when(F.col("_g") > 0, 60 / F.col("_g"))
    r = lambda c: F.round(c, 6)
    return df.withColumn("_g", gap).groupBy(*by).agg(r(F.median(rate)).alias("median"), r(F.min(rate)).alias("slowest"), r(F.max(rate)).alias("fastest"), F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def extremes(df: DataFrame, by: list[str], key: str, measure: str) -> DataFrame:
    order = F.struct(F.col(measure), -F.col(key))
    low = F.struct(F.col(measure), F.col(key))
    return df.groupBy(*by).agg(F.max_by(key, order).alias("most"), F.min_by(key, low).alias("least"), F.count("*").alias("n"), F.round(F.avg(measure), 4).alias("mean"))


def gated_mean(df: DataFrame, by: list[str], level: str) -> DataFrame:
    """Two gates in the power domain: over -70, then over 10 below the mean of those; the first gate alone if none is left."""
    loud = df.where(F.col(level) > -70).withColumn("_p", F.pow(F.lit(10.0), F.col(level) / 10))
    first = F.avg("_p").over(Window.partitionBy(*by))
    loud = loud.withColumn("_keep", F.col(level) > 10 * F.log10(first) - 10)
    return loud.groupBy(*by).agg(F.round(10 * F.log10(F.coalesce(F.avg(F.when(F.col("_keep"), F.col("_p"))), F.avg("_p"))), 4).alias("gated"))


def transcript_stats(words: DataFrame, by: list[str], floor: float) -> DataFrame:
    return words.groupBy(*by).agg(F.count("*").alias("words"), F.round(F.avg("confidence"), 4).alias("confidence"), F.count_if(F.col("confidence") < floor).alias("low"), F.round(F.sum(F.col("stop") - F.col("start")), 3).alias("speech"), F.when(F.max("stop") > F.min("start"), F.round(60 * F.count("*") / (F.max("stop") - F.min("start")), 4)).alias("per_minute"))


def reason_counts(df: DataFrame, by: list[str], reasons: str) -> DataFrame:
    return df.select(*by, F.explode(reasons).alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))


def share_summary(splits: DataFrame, by: list[str]) -> DataFrame:
    """Seconds per label over rows, their share of labelled seconds, and rows whose verdict it is."""
    each = splits.groupBy(*by, "label").agg(F.sum("seconds").alias("s"), F.count_if("verdict").alias("verdicts"))
    total = F.sum(F.when(F.col("label") != "black", F.col("s"))).over(Window.partitionBy(*by))
    return each.select(*by, "label", F.round("s", 2).alias("seconds"), F.when((F.col("label") != "black") & (total > 0), F.round(F.col("s") / total, 4)).alias("share"), "verdicts")


def detection_gist(df: DataFrame, by: list[str], key: str, confidence: str, floor: float) -> DataFrame:
    c = F.col(confidence)
    return df.groupBy(*by).agg(F.count("*").alias("considered"), F.count_if(c >= floor).alias("kept"), F.count_if(c < floor).alias("below"), F.round(F.avg(F.when(c >= floor, c)), 4).alias("mean"), F.max_by(key, F.struct(c, -F.col(key))).alias("strongest"))


def seconds_by_class(spans: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    s = F.col("stop") - F.col("start")
    cols = [F.round(F.coalesce(F.sum(F.when(F.col("label") == c, s)), F.lit(0.0)), 3).alias(c) for c in classes]
    return spans.groupBy(*by).agg(*cols, F.max_by("label", "start").alias("last"), F.count("*").alias("spans"))


def motion_summary(df: DataFrame, by: list[str], still: float = 1.0) -> DataFrame:
    """Moving share, net and path length, and a class: unknown under 3 samples, still, directed or wandering."""
    step = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    m = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((step >= still).cast("double")).alias("share"), F.sqrt(F.pow(F.sum("dx"), 2) + F.pow(F.sum("dy"), 2)).alias("net"), F.sum(step).alias("path"))
    directed = F.when(F.col("path") > 0, F.col("net") / F.col("path")).otherwise(0.0)
    kind = F.when(F.col("n") < 3, "unknown").when(F.col("share") < 0.3, "still").when(directed >= 0.6, "directed").otherwise("wandering")
    return m.select(*by, "n", F.round("share", 4).alias("share"), F.round("net", 3).alias("net"), F.round("path", 3).alias("path"), kind.alias("kind"))


def latest_per_base(df: DataFrame, base: str, version: str, key: str) -> DataFrame:
    return df.groupBy(base).agg(F.max_by(key, F.struct(F.coalesce(version, F.lit(-1)), -F.col(key))).alias(key), F.max(version).alias(version))


def held_level(df: DataFrame, by: list[str], level: str, step: str, seconds: float) -> DataFrame:
    """Highest level reached for `seconds` in total; the lowest if never."""
    w = Window.partitionBy(*by).orderBy(F.desc(level)).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_c", F.sum(step).over(w)).groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_c") >= seconds, F.col(level))), F.min(level)).alias("held"))


def with_step(df: DataFrame, by: list[str]) -> DataFrame:
    """Seconds to the next sample; the last repeats the step before it."""
    w = Window.partitionBy(*by).orderBy("t")
    return df.withColumn("step", F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w), F.lit(0.0)))


def seconds_over(df: DataFrame, by: list[str], level: str, threshold: float) -> DataFrame:
    return with_step(df, by).groupBy(*by).agg(F.round(F.coalesce(F.sum(F.when(F.col(level) >= threshold, F.col("step"))), F.lit(0.0)), 3).alias("over"))


def ordered_digest(df: DataFrame, by: list[str], parts: list[str], order: list[str]) -> DataFrame:
    """sha256 over the rows of a group in order; group sizes are those of one document."""
    text = F.concat_ws("@", *(F.col(p).cast("string") for p in parts))
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_x"))))
    return df.groupBy(*by).agg(F.sha2(F.concat_ws(";", F.transform(rows, lambda r: r["_x"])).cast("binary"), 256).alias("digest"))


def outside_count(points: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Points before the first or after the last grid row; all where the grid is empty."""
    edges = grid.groupBy(*by).agg(F.min("t").alias("_a"), F.max("t").alias("_z"))
    out = F.col("_a").isNull() | (F.col("t") < F.col("_a")) | (F.col("t") > F.col("_z"))
    return points.join(edges, by, "left").groupBy(*by).agg(F.count_if(out).alias("outside"))


def class_counts(df: DataFrame, by: list[str], col: str, classes: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.count_if(F.col(col) == c).alias(c) for c in classes))


def contrast(value: str, chosen: Column) -> Column:
    """(mean inside - mean outside) / population deviation; 0 when a side is empty or all is flat."""
    gap = (F.avg(F.when(chosen, F.col(value))) - F.avg(F.when(~chosen, F.col(value)))) / F.nullif(F.stddev_pop(value), F.lit(0.0))
    return F.coalesce(gap, F.lit(0.0))


def recommend_threshold(col: str, margin: float, grid: float, low: float, high: float) -> Column:
    return F.least(F.greatest(F.floor(F.min(col) * margin / grid) * grid, F.lit(low)), F.lit(high))


def markers_by_name(df: DataFrame, by: list[str], name: str, frame: str) -> DataFrame:
    return df.groupBy(*by, name).agg(F.array_sort(F.collect_list(frame)).alias("frames"))


def grid_report(df: DataFrame, by: list[str], width: float) -> DataFrame:
    """Per time bin: rows, median gap and rate; bins without rows between the first and the last have 0."""
    w = Window.partitionBy(*by).orderBy("t")
    g = df.withColumn("_gap", F.lead("t").over(w) - F.col("t")).withColumn("bin", F.floor(F.col("t") / width))
    each = g.groupBy(*by, "bin").agg(F.count("*").alias("rows"), F.round(F.median("_gap"), 3).alias("gap"))
    every = each.groupBy(*by).agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    return every.join(each, [*by, "bin"], "left").fillna(0, ["rows"])


def gap_report(df: DataFrame, by: list[str], wide: float = 2.0, most: int = 15) -> DataFrame:
    """Gaps between a key's rows in one row: how many, mean, median, 5 % and 95 % quantiles, least and most, how many are over
    `wide`, the share within a tenth of the median of the 31 gaps around, and the `most` largest with the row before them
    (longest first, then earliest). Quantiles by exact_quantiles, so that no task holds a key's gaps."""
    w = Window.partitionBy(*by).orderBy("t")
    g = df.where("t is not null").select(*by, "t", (F.lead("t").over(w) - F.col("t")).alias("gap")).where("gap is not null")
    local = F.percentile("gap", F.lit(0.5)).over(w.rowsBetween(-15, 15))
    g = g.withColumn("_local", local).withColumn("_steady", (F.abs(F.col("gap") - F.col("_local")) <= 0.1 * F.col("_local")).cast("double"))
    g = written(g.drop("_local"), "gaps")
    whole = g.groupBy(*by).agg(F.count("*").alias("gaps"), F.round(F.avg("gap"), 4).alias("mean"), F.round(F.min("gap"), 4).alias("least"), F.round(F.max("gap"), 4).alias("most"), F.count_if(F.col("gap") > wide).alias("wide"), F.round(F.avg("_steady"), 4).alias("steady_share"))
    at = exact_quantiles(g, by, "gap", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    top = g.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gap"), "t"))).where(F.col("_k") <= most)
    top = top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "t", "gap"))), lambda x: F.struct(F.round(x["t"], 2).alias("t"), F.round(x["gap"], 2).alias("gap"))).alias("largest"))
    return whole.join(at.select(*by, *(F.round(c, 4).alias(c) for c in ("p05", "median", "p95"))), by).join(top, by)


def exact_quantiles(df: DataFrame, by: list[str], col: str, shares: dict[str, float], bins: int = 1024, rounds: int = 3, many: int = 65_536) -> DataFrame:
    """Linear-interpolated quantiles of each key without a task that holds its values. Keys of up to `many` values are sorted
    and ranked; those of more, one broadcast entry for each, are counted in `bins` equal bins between the least and the most,
    the bins with the wanted ranks are cut again, `rounds` times; what is left there is counted by value and ranked. Nulls don't
    count; keys without values give null."""
    d = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))
    large = F.broadcast(d.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > many).drop("_n"))
    key = Window.partitionBy(*by)
    ranked = d.join(large, by, "left_anti").withColumns({"_rank": F.row_number().over(key.orderBy("_v")) - 1, "_n": F.count("*").over(key)})
    value = lambda at: F.max(F.when(F.col("_rank") == at, F.col("_v")))
    ats = {name: F.lit(q) * (F.col("_n") - 1) for name, q in shares.items()}
    between = lambda at: value(F.floor(at)) + (value(F.ceil(at)) - value(F.floor(at))) * F.max(at - F.floor(at))
    few = ranked.groupBy(*by).agg(*(between(at).alias(name) for name, at in ats.items()))
    d = d.join(large, by)
    size = d.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # the two ranks each share lies between, from 0
    want = size.select(*by, "_low", "_high", F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), (F.lit(q) * (F.col("_n") - 1)).alias("_at")) for name, q in shares.items()))).alias("x")).select(*by, "_low", "_high", "x.*")
    want = want.select(*by, "_low", "_high", "_name", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct().withColumn("_before", F.lit(0).cast("long"))
    key = [*by, "_name", "_at", "_rank"]
    step = (F.col("_high") - F.col("_low")) / bins
    place = F.when(step > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    inside = lambda w: d.join(w, by).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    for _ in range(rounds):
        n = inside(want).withColumn("_bin", place).groupBy(*key, "_before", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_bin"))
        n = n.withColumn("_upto", F.col("_before") + upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        want = n.select(*key, "_low", "_high", (F.col("_upto") - F.col("_c")).alias("_before"))
    n = inside(want).groupBy(*key, "_before", "_v").agg(F.count("*").alias("_c"))
    n = n.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*key).orderBy("_v"))).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    q = n.groupBy(*by, "_name", "_at").agg((low + (high - low) * (F.col("_at") - F.floor("_at"))).alias("_q"))
    q = q.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in shares))
    return df.select(*by).distinct().join(few.unionByName(q), by, "left")
