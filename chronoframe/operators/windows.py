"""Window functions over a recording, ordered by t. Frames shrink at the ends unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: str = "t"):
    return Window.partitionBy(*by).orderBy(order)


def _median(col: str, frame) -> Column:
    return F.percentile(col, F.lit(0.5)).over(frame)


def intervals(df: DataFrame, by: list[str]) -> DataFrame:
    """gap to the next row, and stop: the next start, for the last one its start + the median positive gap."""
    gap = F.lead("t").over(_w(by)) - F.col("t")
    df = df.withColumn("gap", gap)
    usual = F.percentile(F.when(F.col("gap") > 0, F.col("gap")), F.lit(0.5)).over(Window.partitionBy(*by))
    return df.withColumn("stop", F.col("t") + F.coalesce("gap", usual))


def _nine(by: list[str], gap: str) -> Column:
    """Median of the nine gaps around each; at the head the frame keeps reaching nine forward."""
    w = _w(by)
    wide = F.when(F.row_number().over(w) == 1, _median(gap, w.rowsBetween(0, 8)))
    for k in range(2, 5):
        wide = wide.when(F.row_number().over(w) == k, _median(gap, w.rowsBetween(1 - k, 9 - k)))
    return wide.otherwise(_median(gap, w.rowsBetween(-4, 4)))


def steady_flags(df: DataFrame, by: list[str], tolerance: float = 0.15) -> DataFrame:
    """A row is steady unless a gap beside it differs from the median of the gaps around by more than the tolerance; fewer than two gaps: all steady."""
    w = _w(by)
    df = df.withColumn("_gap", F.lead("t").over(w) - F.col("t"))
    off = F.abs(F.col("_gap") - F.col("_m")) > tolerance * F.col("_m")
    df = df.withColumn("_m", _nine(by, "_gap")).withColumn("_off", F.coalesce(off, F.lit(False)))
    few = F.count("_gap").over(Window.partitionBy(*by)) < 2
    return df.withColumn("steady", few | ~(F.col("_off") | F.coalesce(F.lag("_off").over(w), F.lit(False)))).drop("_gap", "_m", "_off")


def local_spacing(df: DataFrame, by: list[str]) -> DataFrame:
    """Median local gap at each row; the last row takes the one before."""
    w = _w(by)
    df = df.withColumn("_gap", F.lead("t").over(w) - F.col("t")).withColumn("_m", _nine(by, "_gap"))
    return df.withColumn("spacing", F.when(F.col("_gap").isNotNull(), F.col("_m")).otherwise(F.lag("_m").over(w))).drop("_gap", "_m")


def moving_median(df: DataFrame, by: list[str], col: str, width: int = 15) -> DataFrame:
    return df.withColumn("smooth", _median(col, _w(by).rowsBetween(-(width // 2), width // 2)))


def levelled(df: DataFrame, by: list[str], col: str, width: int = 33) -> DataFrame:
    """Value over its local median; 0 where that is not positive. The frame is `width` rows from width // 2 before the row on;
    at the head it starts with the first row and keeps its width."""
    w, half = _w(by), width // 2
    df = df.withColumns({"_i": F.row_number().over(w), "_m": _median(col, w.rowsBetween(-half, width - 1 - half))})
    head = F.max(F.when(F.col("_i") == half + 1, F.col("_m"))).over(Window.partitionBy(*by))
    few = F.percentile(col, F.lit(0.5)).over(Window.partitionBy(*by))
    m = F.when(F.col("_i") > half, F.col("_m")).otherwise(F.coalesce("_head", "_few"))
    df = df.withColumns({"_head": head, "_few": few}).withColumn("_m", m)
    return df.withColumn("levelled", F.when(F.col("_m") > 0, F.col(col) / F.col("_m")).otherwise(0.0)).drop("_i", "_m", "_head", "_few")


def moving_mean_range(df: DataFrame, by: list[str], col: str, width: float) -> DataFrame:
    """Mean over rows within width / 2 in time; microseconds, so that range frames are exact."""
    w = Window.partitionBy(*by).orderBy(F.round(F.col("t") * 1_000_000).cast("long")).rangeBetween(-round(width * 500_000), round(width * 500_000))
    return df.withColumn("mean", F.avg(col).over(w))


def terciles(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """quiet, middle, loud by rank: the bottom n // 3, from rank 2n // 3 on, the rest."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(col, "t")) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("tercile", F.when(r < F.floor(n / 3), "quiet").when(r >= F.floor(2 * n / 3), "loud").otherwise("middle"))


def alternation_run(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Longest strict A/B/A/B stretch, in cuts, and as a share of all cuts; under two cuts it is 0."""
    w = _w(by)
    one, two = F.lag(label).over(w), F.lag(label, 2).over(w)
    df = df.withColumn("_one", one).withColumn("_two", two)
    # a cut goes on with the run before it if it returns to the label before last; each run counts its cuts
    cut = F.col("_one").isNotNull() & (F.col("_one") != F.col(label))
    goes = cut & (F.col("_two") == F.col(label))
    df = df.withColumn("_cut", cut.cast("int")).withColumn("_new", (~F.coalesce(goes, F.lit(False))).cast("int"))
    df = df.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*by, "_i").agg(F.sum("_cut").alias("_n"))
    best = runs.groupBy(*by).agg(F.max("_n").alias("_n"))
    total = df.groupBy(*by).agg((F.count("*") - 1).alias("_cuts"))
    return best.join(total, by).select(*by, F.when(F.col("_n") >= 2, F.col("_n")).otherwise(0).alias("run"), F.when(F.col("_cuts") > 0, F.round(F.when(F.col("_n") >= 2, F.col("_n")).otherwise(0) / F.col("_cuts"), 4)).alias("share"))


def monotone_run(df: DataFrame, by: list[str], col: str, least: int = 4) -> DataFrame:
    """Longest strictly rising or falling stretch, in cuts; an equal value ends it; under `least` cuts it is 0."""
    w = _w(by)
    df = df.withColumn("_s", F.signum(F.col(col) - F.lag(col).over(w)))
    goes = (F.col("_s") == F.lag("_s").over(w)) & (F.col("_s") != 0)
    df = df.withColumn("_i", F.sum((~F.coalesce(goes, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*by, "_i").agg(F.count_if(F.col("_s") != 0).alias("_n"))
    return runs.groupBy(*by).agg(F.max("_n").alias("_n")).select(*by, F.when(F.col("_n") >= least, F.col("_n")).otherwise(0).alias("run"))


def opening_flag(items: DataFrame, by: list[str]) -> DataFrame:
    """First row, or one that doesn't start where the one before stopped."""
    before = F.lag("stop").over(_w(by, "start"))
    return items.withColumn("opens", before.isNull() | (before != F.col("start")))


def orphans(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Shorter than half the median, with two neighbours at or over it."""
    w = _w(by)
    m = F.percentile(col, F.lit(0.5)).over(Window.partitionBy(*by))
    return df.withColumn("orphan", F.coalesce((F.col(col) < m / 2) & (F.lag(col).over(w) >= m) & (F.lead(col).over(w) >= m), F.lit(False)))


def number_groups(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """Group number, one more at each flag (the first row opens group 1), and position inside from 1."""
    w = _w(by)
    first = F.row_number().over(w) == 1
    df = df.withColumn("grp", F.sum((flag | first).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by, "grp").orderBy("t")))


def group_position(n: Column, k: int = 4) -> Column:
    return F.pmod(n - 1, F.lit(k)) + 1


def sequential_layout(entries: DataFrame, by: list[str], order: str = "pos", origin: int = 0) -> DataFrame:
    """Entries laid end to end in order: start, stop and the total."""
    w = Window.partitionBy(*by).orderBy(order)
    stop = F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, 0)) + origin
    return entries.withColumns({"stop": stop, "start": stop - F.col("duration"), "total": F.sum("duration").over(Window.partitionBy(*by))})


def trend_residual(df: DataFrame, by: list[str], width: float) -> DataFrame:
    """1 - distance of (dx, dy) from the mean of five neighbours over 2 % of the width, 0 at least; a discontinuity scores null and breaks the neighbourhood."""
    w = _w(by)
    df = df.withColumn("_i", F.sum(F.col("discontinuity").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy(*by, "_i", "discontinuity").orderBy("t").rowsBetween(-2, 2)
    ex, ey = F.col("dx") - F.avg("dx").over(near), F.col("dy") - F.avg("dy").over(near)
    score = F.greatest(F.lit(0.0), 1 - F.sqrt(ex * ex + ey * ey) / (0.02 * width))
    return df.withColumn("stability", F.when(~F.col("discontinuity"), score)).drop("_i")


def onset_peaks(df: DataFrame, by: list[str], col: str, width: int = 15, factor: float = 1.5, floor: float = 0.2) -> DataFrame:
    """Local maxima over the larger of factor * moving median and floor; the ends are no peaks."""
    w = _w(by)
    df = moving_median(df, by, col, width)
    top = (F.col(col) > F.lag(col).over(w)) & (F.col(col) >= F.lead(col).over(w)) & (F.col(col) > F.greatest(factor * F.col("smooth"), F.lit(floor)))
    return df.withColumn("peak", F.coalesce(top, F.lit(False))).drop("smooth")


def _range(by: list[str], seconds: float):
    return Window.partitionBy(*by).orderBy(F.round(F.col("t") * 1_000_000).cast("long")).rangeBetween(-round(seconds * 1_000_000), round(seconds * 1_000_000))


def prominent_peaks(df: DataFrame, by: list[str], col: str, reach: float, base: float, rise: float) -> DataFrame:
    """Rows that are the most within reach and rise over the least within base; of peaks within reach of each other the highest, the first on a tie."""
    hit = (F.col(col) == F.max(col).over(_range(by, reach))) & (F.col(col) - F.min(col).over(_range(by, base)) >= rise)
    peaks = df.withColumn("_hit", hit).where("_hit").drop("_hit")
    w = _w(by)
    peaks = peaks.withColumn("_i", F.sum((F.coalesce(F.col("t") - F.lag("t").over(w) > reach, F.lit(True))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy(*by, "_i").orderBy(F.desc(col), "t"))
    return peaks.withColumn("_k", best).where("_k = 1").drop("_k", "_i")


def step_change(df: DataFrame, by: list[str], col: str, span: int, least: float = 4.0) -> DataFrame:
    """Rows where the median of the next `span` values is `least` semitones from that of the last; of consecutive hits the sharpest."""
    w = _w(by)
    before, after = _median(col, w.rowsBetween(-span, -1)), _median(col, w.rowsBetween(0, span - 1))
    df = df.withColumn("_n", F.row_number().over(w)).withColumns({"_b": before, "_a": after})
    size = F.abs(12 * F.log2(F.col("_a") / F.col("_b")))
    df = df.withColumn("step", F.when((F.col("_b") > 0) & (F.col("_a") > 0), size)).where(F.col("step") >= least)
    df = df.withColumn("_i", F.col("_n") - F.row_number().over(w))
    k = F.row_number().over(Window.partitionBy(*by, "_i").orderBy(F.desc("step"), "t"))
    return df.withColumn("_k", k).where("_k = 1").drop("_n", "_b", "_a", "_i", "_k")


def rise_bonus(df: DataFrame, by: list[str], col: str, q: float = 0.2, full: float = 0.3, bonus: float = 0.15) -> DataFrame:
    """Excess over the group's low quantile, over `full`, at most 1, and up to `bonus` for a rise since the row before."""
    base = F.percentile(col, F.lit(q)).over(Window.partitionBy(*by))
    rise = F.col(col) - F.lag(col).over(_w(by))
    score = F.least(F.greatest((F.col(col) - base) / full, F.lit(0.0)), F.lit(1.0)) + F.least(F.greatest(F.coalesce(rise, F.lit(0.0)), F.lit(0.0)), F.lit(bonus))
    return df.withColumn("score", score)


def isolated_label_smooth(df: DataFrame, by: list[str], label: str, protected: str) -> DataFrame:
    """A label that differs from two equal neighbours becomes theirs, unless it is protected."""
    w = _w(by)
    a, b = F.lag(label).over(w), F.lead(label).over(w)
    return df.withColumn("smooth", F.when((a == b) & (F.col(label) != a) & (F.col(label) != protected), a).otherwise(F.col(label)))


def local_baseline_excluding(df: DataFrame, by: list[str], col: str, half: int, skip: int) -> DataFrame:
    """Median over half rows to each side but for skip around the row."""
    w = _w(by)
    around = F.array_sort(F.concat(F.collect_list(col).over(w.rowsBetween(-half, -skip - 1)), F.collect_list(col).over(w.rowsBetween(skip + 1, half))))
    n = F.size("_v")
    mid = lambda k: F.element_at("_v", k.cast("int"))
    return df.withColumn("_v", around).withColumn("baseline", F.when(n > 0, (mid(F.floor((n + 1) / 2)) + mid(F.floor(n / 2) + 1)) / 2)).drop("_v")


def first_sustained(df: DataFrame, by: list[str], level: str, floor: float | Column, hold: float | Column, share: float = 0.75) -> DataFrame:
    """Per key the first t over the floor from which on `hold` seconds stay over it for the share. The hold counts in rows, by
    the median gap of the key; a key with fewer rows than that, or without a gap, is not measured. Running counts are read
    off at both ends of the hold, so its length may differ from key to key."""
    w = _w(by)
    floor, hold = (c if isinstance(c, Column) else F.lit(c) for c in (floor, hold))
    d = df.where(F.col(level).isNotNull()).withColumns({"_over": (F.col(level) >= floor).cast("long"), "_gap": F.lead("t").over(w) - F.col("t"), "_i": F.row_number().over(w), "_hold": hold})
    d = d.withColumn("_sum", F.sum("_over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.percentile("_gap", F.lit(0.5))
    rows = F.when(step > 0, F.greatest(F.bround(F.try_divide(F.max("_hold"), step)).cast("long"), F.lit(1)))
    size = d.groupBy(*by).agg(rows.alias("_rows"), F.count("*").alias("_n"))
    size = size.withColumn("measured", F.coalesce(F.col("_n") >= F.col("_rows"), F.lit(False)) & (F.col("_n") >= 2))
    d = d.join(size.where("measured"), by)
    ends = d.select(*by, (F.col("_i") - F.col("_rows") + 1).alias("_i"), F.col("_sum").alias("_end")).where("_i >= 1")
    held = d.select(*by, "_i", "t", "_over", "_rows", (F.col("_sum") - F.col("_over")).alias("_before")).join(ends, [*by, "_i"])
    came = held.where((F.col("_over") == 1) & (F.col("_end") - F.col("_before") >= share * F.col("_rows"))).groupBy(*by).agg(F.min("t").alias("t"))
    return size.select(*by, "measured").join(came, by, "left")


def windows_around(df: DataFrame, by: list[str], win: float, hop: float) -> DataFrame:
    """Each row once for every window [start, start + win) of a multiple of hop that holds it."""
    k = F.floor(F.col("t") / hop)
    df = df.withColumn("_k", F.explode(F.sequence(k - int(win // hop), k)))
    return df.withColumn("start", F.col("_k") * hop).where((F.col("start") <= F.col("t")) & (F.col("t") < F.col("start") + win)).drop("_k")


def hopping_windows(df: DataFrame, by: list[str], win: float, hop: float) -> DataFrame:
    """Each row once for every window [start, start + win) that holds it, with the window's span. Windows start with the
    series, every hop; whole ones only, that end by its last row. A series shorter than one window is one short window, last
    row included. Times count in microseconds."""
    us, wide, far = F.round(F.col("t") * 1_000_000).cast("long"), round(win * 1_000_000), round(hop * 1_000_000)
    key = Window.partitionBy(*by)
    df = df.where("t is not null").withColumn("_u", us).withColumns({"_f": F.min("_u").over(key), "_l": F.max("_u").over(key)})
    rel, room = F.col("_u") - F.col("_f"), F.col("_l") - F.col("_f") - wide
    first = F.greatest(F.floor((rel - wide) / far) + 1, F.lit(0))
    last = F.least(F.floor(rel / far), F.floor(room / far))
    held = F.when(room < 0, F.array(F.lit(0).cast("long"))).when(first <= last, F.sequence(first, last))
    span = F.when(room < 0, F.col("_l") - F.col("_f")).otherwise(wide) / 1_000_000
    df = df.withColumns({"span": span, "_k": F.explode(held)})
    return df.withColumn("start", (F.col("_f") + F.col("_k") * far) / 1_000_000).drop("_u", "_f", "_l", "_k")


def window_table(samples: DataFrame, by: list[str], win: float, hop: float, channels: list[Column], plain: Column, onset: Column, floor: float | None = -120.0) -> DataFrame:
    """Per whole window: lufs from the channels' weighted mean squares, level in dBFS of the plain values, onsets a second.
    channels: weighted samples, whose squares are averaged; a short window's rate is over its own span. Levels have the floor
    of dbfs()."""
    from ..functions.columns import dbfs, lufs

    w = hopping_windows(samples, by, win, hop)
    loud = lufs([F.avg(c * c) for c in channels], floor)
    rate = F.try_divide(F.count_if(onset), F.first("span"))
    return w.groupBy(*by, "start").agg(F.round(loud, 2).alias("lufs"), F.round(dbfs(F.avg(plain * plain), floor), 2).alias("rms"), F.round(rate, 9).alias("onsets"))


def tumbling_level(df: DataFrame, by: list[str], col: str, width: float) -> DataFrame:
    """RMS per window in dBFS."""
    from ..functions.columns import dbfs

    at = F.floor(F.col("t") / width) * width
    return df.groupBy(*by, at.cast("double").alias("t")).agg(F.round(dbfs(F.avg(F.col(col) * F.col(col))), 4).alias("level"))


def leader(df: DataFrame, by: list[str], name: str, level: str, margin: float) -> DataFrame:
    """Per (key, t) the top series if it leads the second by the margin, else null."""
    w = Window.partitionBy(*by, "t").orderBy(F.desc(level), F.desc(name))
    df = df.withColumns({"_k": F.row_number().over(w), "_second": F.lead(level).over(w)}).where("_k = 1")
    return df.select(*by, "t", F.when(F.col("_second").isNull() | (F.col(level) - F.col("_second") >= margin), F.col(name)).alias("leader"))


def prominence(df: DataFrame, by: list[str], level: str, depth: float = 40.0) -> DataFrame:
    """Level over the larger of its 5 % quantile and its maximum less depth, 0 to depth."""
    p = Window.partitionBy(*by)
    base = F.greatest(F.percentile(level, F.lit(0.05)).over(p), F.max(level).over(p) - depth)
    return df.withColumn("lift", F.least(F.greatest(F.col(level) - base, F.lit(0.0)), F.lit(depth)))


def jump_seams(entries: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Seams between neighbours of one source: the entries whose predecessor has the same source."""
    return entries.withColumn("jump", F.coalesce(F.lag("source").over(_w(by, "pos")) == F.col("source"), F.lit(False)))


def repeated_seam(df: DataFrame, by: list[str], tokens: str, order: str) -> DataFrame:
    """Length of the longest suffix of the row before that is a prefix of this one."""
    df = df.withColumn("_p", F.lag(tokens).over(_w(by, order)))
    n = F.least(F.size("_p"), F.size(tokens))
    fits = F.filter(F.sequence(F.lit(1), n), lambda k: F.slice(F.col("_p"), F.size("_p") - k + 1, k) == F.slice(F.col(tokens), 1, k))
    return df.withColumn("repeated", F.when(n >= 1, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0)).drop("_p")


def furthest_overlap(spans: DataFrame, by: list[str], key: str) -> DataFrame:
    """Each span against the earlier one that reaches furthest: its key where they overlap."""
    w = Window.partitionBy(*by).orderBy("start", key).rowsBetween(Window.unboundedPreceding, -1)
    df = spans.withColumn("_m", F.max(F.struct("stop", (-F.col(key)).alias("k"))).over(w))
    return df.withColumn("overlaps", F.when(F.col("_m.stop") > F.col("start"), -F.col("_m.k"))).drop("_m")


def best_window(spans: DataFrame, changes: DataFrame, strong: DataFrame, weaker: DataFrame, levels: DataFrame, by: list[str], length: float, step: float) -> DataFrame:
    """Of the windows of `length` that start every `step` in each span (lo, hi), the one with the best score, the earliest on a
    tie: 3 for each change, 0.1 and 0.05 for each strong event of two kinds, half of the range of levels over 6, and 1 if it
    holds the highest level of the span (the first one). Ends count as inside. Rows are t, and level."""
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    long, far = round(length * 1_000_000), round(step * 1_000_000)
    edges = spans.select(*by, us("lo").alias("_lo"), us("hi").alias("_hi")).where(F.col("_lo") + long <= F.col("_hi"))
    kinds = [df.select(*by, us("t").alias("_u"), F.lit(k).alias("_kind"), (F.col("level") if k == 3 else F.lit(None)).cast("double").alias("_v")) for k, df in enumerate((changes, strong, weaker, levels))]
    rows = kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3]).join(edges, by).where("_u >= _lo and _u <= _hi")
    peak = rows.where("_kind = 3 and _v is not null").groupBy(*by).agg(F.max_by("_u", F.struct("_v", -F.col("_u"))).alias("_peak"))
    rel = F.col("_u") - F.col("_lo")
    held = F.sequence(F.greatest(F.ceil((rel - long) / far), F.lit(0)), F.least(F.floor(rel / far), F.floor((F.col("_hi") - F.col("_lo") - long) / far)))
    rows = rows.where(F.ceil((rel - long) / far) <= F.floor((F.col("_hi") - F.col("_lo") - long) / far)).withColumn("_k", F.explode(held))
    n = lambda k: F.count_if(F.col("_kind") == k)
    each = rows.groupBy(*by, "_k").agg(n(0).alias("changes"), n(1).alias("strong"), n(2).alias("weaker"), (F.max("_v") - F.min("_v")).alias("range"))
    every = edges.select(*by, "_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo") - long) / far))).alias("_k"))
    each = every.join(each, [*by, "_k"], "left").join(peak, by, "left").fillna(0, ["changes", "strong", "weaker"])
    start = F.col("_lo") + F.col("_k") * far
    peaked = F.coalesce((F.col("_peak") >= start) & (F.col("_peak") <= start + long), F.lit(False))
    score = 3.0 * F.col("changes") + 0.1 * F.col("strong") + 0.05 * F.col("weaker") + 0.5 * F.coalesce("range", F.lit(0.0)) / 6 + peaked.cast("double")
    each = each.select(*by, (start / 1_000_000).alias("start"), "changes", "strong", "weaker", F.round("range", 2).alias("range"), peaked.alias("peak"), F.round(score, 3).alias("score"))
    cols = ["start", "changes", "strong", "weaker", "range", "peak", "score"]
    return each.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct("score", -F.col("start"))).alias("x")).select(*by, "x.*")


def refine_boundary(samples: DataFrame, bounds: DataFrame, by: list[str], key: str, reach: float, span: float) -> DataFrame:
    """Within reach of a boundary, the instant with the largest difference of mean level after and before; unchanged if none."""
    us = Window.partitionBy(*by).orderBy(F.round(F.col("t") * 1_000_000).cast("long"))
    n = round(span * 1_000_000)
    diff = F.abs(F.avg("level").over(us.rangeBetween(0, n)) - F.avg("level").over(us.rangeBetween(-n, -1)))
    s = samples.withColumn("_d", F.round(diff, 6)).where("_d is not null").select(*by, F.col("t").alias("_t"), "_d").withColumn("_b", F.explode(F.sequence(F.floor(F.col("_t") / reach) - 1, F.floor(F.col("_t") / reach) + 1)))
    m = bounds.withColumn("_b", F.floor(F.col("t") / reach)).join(s, [*by, "_b"]).where(F.abs(F.col("_t") - F.col("t")) <= reach)
    best = m.groupBy(*by, key).agg(F.max_by("_t", F.struct("_d", -F.col("_t"))).alias("refined"))
    return bounds.join(best, [*by, key], "left").withColumn("refined", F.coalesce("refined", "t"))


def flux(df: DataFrame, by: list[str], vec: str, order: str, floor: float = 1e-9) -> DataFrame:
    """Rise of a vector since the row before, over its sum."""
    df = df.withColumn("_p", F.lag(vec).over(_w(by, order)))
    rise = F.aggregate(F.zip_with(vec, "_p", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("flux", rise / (F.aggregate(vec, F.lit(0.0), lambda s, x: s + x) + floor)).drop("_p")


def blend_fit(df: DataFrame, by: list[str], vec: str, order: str, k: int = 1) -> DataFrame:
    """Least-squares alpha of a vector between those k rows before and after, and its relative residual."""
    w = _w(by, order)
    df = df.withColumns({"_a": F.lag(vec, k).over(w), "_b": F.lead(vec, k).over(w)})
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    df = df.withColumns({"_d": F.zip_with("_b", "_a", lambda p, q: p - q), "_m": F.zip_with(vec, "_a", lambda p, q: p - q)})
    df = df.withColumn("alpha", F.try_divide(dot(F.col("_m"), F.col("_d")), dot(F.col("_d"), F.col("_d"))))
    rest = F.sqrt(F.greatest(dot(F.col("_m"), F.col("_m")) - F.col("alpha") * dot(F.col("_m"), F.col("_d")), F.lit(0.0)))
    return df.withColumn("residual", F.when(F.col("alpha").isNotNull(), F.try_divide(rest, F.sqrt(dot(F.col("_m"), F.col("_m")))))).drop("_a", "_b", "_d", "_m")
