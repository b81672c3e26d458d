"""Shapes of a curve: how it starts and ends, descents, transitions and named checks of a ramp."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, by: list[str]) -> tuple[DataFrame, Window, Window]:
    """With _i from 0 and _n; the key in order of time, and the whole key."""
    w, key = Window.partitionBy(*by).orderBy("t"), Window.partitionBy(*by)
    return df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(key)}), w, key


def descent(df: DataFrame, by: list[str], level: str, rate: float, dark: float = 6.0, floor: float = 0.2, margin: float = 0.15, slope: float = 1.0, pause: float = 0.3, plateau: float = 0.5, top: float = 0.9, least: float = 1.0, most: float = 12.0, monotone: float = 0.7) -> DataFrame:
    """How a curve goes down to its end, read from there: where it is black, where the descent began (pauses of up to `pause`
    seconds allowed), the plateau it left, the last row at `top` of that, and the share of steps down from there.
    kind: unknown, ends_lit, black_window, hard_to_black, dissolve_to_black or dim_to_black. rate: rows a second."""
    d, w, key = _numbered(df.select(*by, "t", F.col(level).alias("_v")), by)
    i, v = F.col("_i"), F.col("_v")
    final = F.max_by("_v", "_i").over(key)
    d = d.withColumns({"_final": final, "_max": F.max("_v").over(key)}).withColumn("_black", F.greatest(F.lit(floor), F.col("_final") + margin))
    d = d.withColumn("_at", F.coalesce(F.max(F.when(v > F.col("_black"), i)).over(key) + 1, F.lit(0)))
    k, tolerance, back = max(round(0.15 * rate), 1), max(round(pause * rate), 1), round(plateau * rate)
    after, before = F.coalesce(F.lead("_v", k).over(w), F.col("_final")), F.coalesce(F.lag("_v", k).over(w), F.first("_v").over(w))
    steps = F.least(i + k, F.col("_n") - 1) - F.greatest(i - k, F.lit(0))
    d = d.withColumn("_down", (i < F.col("_at")) & ((after - before) / (steps / rate) <= -slope))
    # rows going down, from the end: the first pause that is too long ends the descent
    later = Window.partitionBy(*by).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.coalesce(F.min(F.when(F.col("_down"), i)).over(later), F.col("_at"))
    d = d.withColumn("_broken", (i < F.col("_at")) & (nearest - i > tolerance))
    d = d.withColumn("_stop", F.coalesce(F.max(F.when(F.col("_broken"), i)).over(key), F.lit(-1)))
    d = d.withColumn("_from", F.coalesce(F.min(F.when(F.col("_down") & (i > F.col("_stop")), i)).over(key), F.col("_at")))
    d = d.withColumn("_plateau", F.max(F.when(i.between(F.greatest(F.col("_from") - back, F.lit(0)), F.col("_from")), v)).over(key))
    d = d.withColumn("_ramp", F.coalesce(F.max(F.when(i.between(F.col("_from"), F.col("_at")) & (v >= top * F.col("_plateau")), i)).over(key), F.col("_from")))
    d = d.withColumn("_step", F.when((i > F.col("_ramp")) & (i <= F.col("_at")), (v <= F.lag("_v").over(w)).cast("double")))
    time = lambda at: F.max(F.when(i == F.col(at), F.col("t")))
    g = d.groupBy(*by, "_n", "_final", "_max", "_at", "_plateau").agg(time("_at").alias("black_at"), time("_from").alias("descent_at"), time("_ramp").alias("ramp_at"), F.coalesce(F.avg("_step"), F.lit(1.0)).alias("share"))
    ramp = F.col("black_at") - F.col("ramp_at")
    soft = F.when((ramp <= most) & (F.col("share") >= monotone), "dissolve_to_black").otherwise("dim_to_black")
    kind = F.when(F.col("_n") < 3, "unknown").when(F.col("_final") > dark, "ends_lit").when((F.col("_at") == 0) | (F.col("_max") <= dark), "black_window").when(ramp < least, "hard_to_black").otherwise(soft)
    some = lambda c: F.when(kind.isin("hard_to_black", "dissolve_to_black", "dim_to_black"), c)
    return g.select(
        *by, kind.alias("kind"), F.when(~kind.isin("unknown", "ends_lit"), F.round("black_at", 3)).alias("black_at"), some(F.round("descent_at", 3)).alias("descent_at"),
        some(F.round("_plateau", 2)).alias("plateau"), some(F.round("ramp_at", 3)).alias("ramp_at"), some(F.round("share", 3)).alias("monotone_share"),
    )


def head_and_tail(df: DataFrame, by: list[str], level: str, head: float, tail: float, floor: float, hold: float = 2.0) -> DataFrame:
    """How a curve starts and ends. reaches: first time at 98 % of the peak of the first `head` seconds; plateau: seconds from
    the second row on that stay within `hold` of it; leaves: last time at 97 % of the median of all but the last `tail`
    seconds; black_from: start of the trailing run at or under the floor, and whether it is a hard cut or a dissolve."""
    d, w, key = _numbered(df.select(*by, "t", F.col(level).alias("_v")), by)
    i, v, t = F.col("_i"), F.col("_v"), F.col("t")
    d = d.withColumns({"_first": F.min("t").over(key), "_end": F.max("t").over(key), "_second": F.max(F.when(i == 1, v)).over(key), "_was": F.lag("_v").over(w)})
    in_head = t <= F.col("_first") + head
    d = d.withColumns({
        "_peak": F.max(F.when(in_head, v)).over(key), "_body": F.percentile(F.when(t <= F.col("_end") - tail, v), F.lit(0.5)).over(key),
        "_off": F.coalesce(F.min(F.when((i >= 1) & (F.abs(v - F.col("_second")) > hold), i)).over(key), F.col("_n")), "_lit": F.coalesce(F.max(F.when(v > floor, i)).over(key), F.lit(-1)),
    })
    g = d.groupBy(*by, "_body", "_lit", "_n").agg(
        F.min(F.when(in_head & (v >= 0.98 * F.col("_peak")), t)).alias("reaches"), (F.max(F.when((i >= 1) & (i < F.col("_off")), t)) - F.min(F.when(i == 1, t))).alias("plateau"),
        F.max(F.when(v >= 0.97 * F.col("_body"), t)).alias("leaves"), F.min(F.when(i > F.col("_lit"), t)).alias("black_from"), F.max(F.when(i == F.col("_lit"), v)).alias("_last"),
    )
    kind = F.when(F.col("black_from").isNull(), "unknown").when(F.col("_last") > 0.8 * F.col("_body"), "hard").otherwise("dissolve")
    return g.select(*by, "reaches", "plateau", F.round("_body", 6).alias("body"), "leaves", "black_from", kind.alias("kind"))


def transition_kind(df: DataFrame, by: list[str], vec: str, noise: float = 1.5, black: float = 12.0, lit: float = 30.0, share: float = 0.25, residual: float = 0.35) -> DataFrame:
    """What happens in a short window of pictures, from the differences of neighbours: none, a fade against black, a dissolve
    (a ramp of two or more steps around the largest, whose inner rows are blends of its ends) or hard; unknown under three rows."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    d, w, key = _numbered(df.select(*by, "t", F.col(vec).alias("_v")), by)
    step = total(F.zip_with("_v", F.lag("_v").over(w), lambda a, b: F.abs(a - b))) / F.size("_v")
    d = d.withColumns({"_d": step, "_l": total(F.col("_v")) / F.size("_v")})
    i = F.col("_i")
    d = d.withColumns({"_peak": F.max("_d").over(key), "_max": F.max("_l").over(key)}).withColumn("_p", F.min(F.when(F.col("_d") == F.col("_peak"), i)).over(key))
    small = F.col("_d") < F.greatest(share * F.col("_peak"), F.lit(noise))
    d = d.withColumns({"_a": F.coalesce(F.max(F.when(small & (i < F.col("_p")), i)).over(key) + 1, F.lit(1)), "_b": F.coalesce(F.min(F.when(small & (i > F.col("_p")), i)).over(key), F.col("_n")) - 1})
    d = d.withColumns({"_pre": F.max(F.when(i == F.col("_a") - 1, F.col("_v"))).over(key), "_post": F.max(F.when(i == F.col("_b"), F.col("_v"))).over(key)})
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    span, own = F.zip_with("_post", "_pre", lambda p, q: p - q), F.zip_with("_v", "_pre", lambda p, q: p - q)
    off = F.sqrt(F.greatest(dot(own, own) - F.try_divide(dot(own, span) * dot(own, span), dot(span, span)), F.lit(0.0)))
    rest = F.try_divide(off, F.sqrt(dot(own, own)))
    g = d.groupBy(*by, "_n", "_peak", "_max", "_a", "_b").agg(
        F.count_if(F.col("_l") <= black).alias("_dark"), F.count_if((F.col("_l") > black) & (F.col("_l") < 0.8 * F.col("_max"))).alias("_mid"),
        F.max(F.when((i >= F.col("_a")) & (i < F.col("_b")), rest)).alias("_worst"),
    )
    ramp = F.col("_b") - F.col("_a") + 1
    fade = (F.col("_dark") > 0) & (F.col("_max") >= lit) & (F.col("_mid") >= 2)
    kind = F.when(F.col("_n") < 3, "unknown").when(F.col("_peak") < noise, "none").when(fade, "fade").when((ramp >= 2) & (F.coalesce("_worst", F.lit(1.0)) <= residual), "dissolve").otherwise("hard")
    rows = F.when(kind == "none", 0).when(kind == "fade", F.col("_mid")).when(kind != "unknown", ramp)
    return g.select(*by, kind.alias("kind"), F.round("_peak", 4).alias("peak"), rows.cast("long").alias("ramp"))


def tail_checks(df: DataFrame, by: list[str], level: str, second: str, starts: str, stops: str, width: float, least: int = 20, slack: float = 0.02, quiet: float = -40.0) -> DataFrame:
    """Named checks of a ramp between the columns starts and stops: enough rows between its ends' levels, spanning seven tenths
    of it, falling within `slack`, landing low; the second series falling from one bin of `width` to the next, ending quiet.
    Levels are shares of the mean of the rows before the ramp."""
    w = Window.partitionBy(*by).orderBy("t")
    steady = F.avg(F.when(F.col("t") < F.col(starts), F.col(level))).over(Window.partitionBy(*by))
    d = df.withColumn("_r", F.when(F.col("t").between(F.col(starts), F.col(stops)), F.col(level) / F.greatest(steady, F.lit(1e-9))))
    d = d.withColumns({"_rise": F.col("_r") - F.lag("_r").over(w), "_mid": F.when((F.col("_r") > 0.08) & (F.col("_r") < 0.92), F.col("t"))})
    g = d.groupBy(*by).agg(
        (F.count("_mid") >= least).alias("ramps"), F.coalesce(F.max("_mid") - F.min("_mid") > 0.7 * (F.max(stops) - F.max(starts)), F.lit(False)).alias("spans"),
        F.coalesce(F.max("_rise") <= slack, F.lit(True)).alias("falls"), F.coalesce(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("t"))) < slack, F.lit(False)).alias("lands"),
        F.coalesce(F.max_by(second, "t") < quiet, F.lit(False)).alias("ends_quiet"),
    )
    bins = df.where(F.col("t") >= F.col(starts)).groupBy(*by, F.floor(F.col("t") / width).alias("_b")).agg(F.round(F.avg(second), 6).alias("_m"))
    bins = bins.withColumn("_up", F.col("_m") >= F.lag("_m").over(Window.partitionBy(*by).orderBy("_b")))
    fade = bins.groupBy(*by).agg(((F.count("*") > 2) & ~F.coalesce(F.bool_or("_up"), F.lit(False))).alias("fades"))
    checks = ["ramps", "spans", "falls", "lands", "fades", "ends_quiet"]
    out = g.join(fade, by, "left").withColumn("fades", F.coalesce("fades", F.lit(False)))
    passed = F.lit(True)
    for c in checks:
        passed &= F.col(c)
    return out.select(*by, *checks, passed.alias("passed"))
