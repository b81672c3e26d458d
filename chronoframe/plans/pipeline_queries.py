"""Queries over the analyses (I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import pipelines as P
from . import sections as S
from .registry import items, levels, of_type, query, recordings, sections, sql
from .scalar_queries import FLOORS

BY = ["rec_id"]


def _changes(s, d):
    w = Window.partitionBy("rec_id").orderBy("t")
    return of_type(s, d, "purchase").select("rec_id", "t", F.lag(F.col("event_id").cast("string")).over(w).alias("was"), F.col("event_id").cast("string").alias("to"))


def _correlated(s, d):
    return P.correlate(items(s, d), of_type(s, d, "view"), _changes(s, d), sections(s, d), BY, "event_id")


_CORR = (
    "+v AS (SELECT rec_id, t, lead(t) OVER w - t AS gap FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY rec_id ORDER BY t)), "
    "sp AS (SELECT rec_id, t, quantile_cont(gap, 0.5) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS sp FROM v), "
    "a AS (SELECT i.*, (SELECT sp.t FROM sp WHERE sp.rec_id = i.rec_id ORDER BY abs(sp.t - i.t), sp.t LIMIT 1) AS vt, (SELECT sp.sp FROM sp WHERE sp.rec_id = i.rec_id ORDER BY abs(sp.t - i.t), sp.t LIMIT 1) AS vs, "
    "coalesce(lag(t + seconds) OVER w <> t, TRUE) AS opens, "
    "(SELECT event_id::VARCHAR FROM e p WHERE p.rec_id = i.rec_id AND p.event_type = 'purchase' AND p.t <= i.t ORDER BY p.t DESC LIMIT 1) AS state, "
    "(SELECT section FROM sections s WHERE s.rec_id = i.rec_id AND s.start <= i.t AND (s.stop IS NULL OR i.t < s.stop)) AS section FROM items i WINDOW w AS (PARTITION BY rec_id ORDER BY t)), "
    "c AS (SELECT *, t - vt AS off, abs(t - vt) > vs AS stranded FROM a) "
)


@query("i08_correlate", sql(_CORR + "SELECT event_id, round(off, 3) AS off, opens, stranded, state, section FROM c", "e", "items", "sections"))
def i08(s, d):
    return _correlated(s, d).select("event_id", F.round("offset", 3).alias("off"), "opens", "stranded", "state", "section")


@query("i09_correlate_summary", sql(_CORR + ", o AS (SELECT *, CASE WHEN NOT opens AND NOT coalesce(stranded, FALSE) THEN round(off, 3) END AS o FROM c) SELECT rec_id, count(o) AS measured, round(avg(abs(o)), 3) AS mean, round(median(abs(o)), 3) AS median, count(*) FILTER (WHERE o < 0) AS early, count(*) FILTER (WHERE opens) AS openings, count(*) FILTER (WHERE stranded) AS stranded, count(*) FILTER (WHERE section IS NULL) AS outside FROM o GROUP BY 1", "e", "items", "sections"))
def i09(s, d):
    return P.correlate_summary(_correlated(s, d), BY)


@query("i01_grid_trust")
def i01(s, d):
    return P.grid_trust(recordings(s, d).withColumn("day", F.floor(F.col("t") / 86400)), BY, "day").select("event_id", "pos", "steady", "trusted", F.array_join("refused", ",").alias("refused"))


@query("i03_adaptive_threshold", sql("+x AS (SELECT *, coalesce(lead(t) OVER w - t, t - lag(t) OVER w, 0) AS step FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY t)), y AS (SELECT rec_id, value, step, sum(step) OVER (PARTITION BY rec_id ORDER BY value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM x) SELECT rec_id, round(CASE WHEN sum(step) FILTER (WHERE value >= 80) >= 300000 THEN 80 ELSE greatest(2, 0.5::DOUBLE * coalesce(max(value) FILTER (WHERE c >= 300000), min(value))) END, 6)::DOUBLE AS threshold FROM y GROUP BY 1", "e"))
def i03(s, d):
    return P.adaptive_threshold(recordings(s, d), BY, "value", 80.0, 300_000.0, 0.5, 2.0).select("rec_id", F.round("threshold", 6).alias("threshold"))


@query("i04_quiet_sections")
def i04(s, d):
    return P.quiet_sections(recordings(s, d), of_type(s, d, "click"), BY, "value", 30.0, 7200.0, 60.0, 3600.0, 1e-6).select("rec_id", "start", "stop", "n", "reason")


@query("i05_lead_changes")
def i05(s, d):
    e = recordings(s, d).groupBy("rec_id", (F.floor(F.col("t") / 86400) * 86400).cast("double").alias("t"), "event_type").agg(F.sum("value").alias("level"))
    return P.lead_changes(e, of_type(s, d, "view"), BY, "event_type", "level", 1.0, 86400.0, 36000.0)


@query("i10_rhythm")
def i10(s, d):
    return P.rhythm(items(s, d), BY)


@query("i11_gears")
def i11(s, d):
    return P.gears(items(s, d), levels(s, d), BY, 3600.0)


@query("i13_quality_catalog")
def i13(s, d):
    v, n = F.col("value"), F.row_number().over(Window.partitionBy("rec_id").orderBy("t")).cast("long")
    x = recordings(s, d).select("rec_id", n.alias("i"), v.alias("sharpness"), (v / 1000).alias("clipped"), F.when(F.col("event_type") != "view", v / 100).alias("stability"))
    return P.quality_catalog(x, BY, FLOORS, "i")


@query("i17_segment_table", sql("+p AS (SELECT rec_id, unnest([min(t), max(t)]) AS t FROM e GROUP BY 1 UNION SELECT rec_id, t FROM e WHERE event_type = 'view'), q AS (SELECT rec_id, lead(t) OVER (PARTITION BY rec_id ORDER BY t) - t AS s FROM p QUALIFY s > 0) SELECT rec_id, count(*) AS segments, round(3600 * count(*) / sum(s), 6) AS per_hour, round(avg(s), 3) AS mean, round(median(s), 3) AS median FROM q GROUP BY 1", "e"))
def i17(s, d):
    return P.segment_table(of_type(s, d, "view"), recordings(s, d).groupBy("rec_id").agg(F.min("t").alias("first"), F.max("t").alias("last")), BY)


@query("i19_event_rank")
def i19(s, d):
    return P.event_rank(recordings(s, d).withColumnRenamed("event_type", "kind"), BY, "event_id", 21600.0, 86400.0, 5)


@query("i20_threshold_sweep")
def i20(s, d):
    return P.threshold_sweep(recordings(s, d), of_type(s, d, "error"), BY, "value", [10.0, 20.0, 40.0], 7200.0, 60.0, 36000.0)


#: Settings of the sections: hours instead of seconds, as events are that far apart.
_SETTINGS = {"ceiling": 60.0, "gap": 7200.0, "burst": 7200.0, "minimum": 36000.0, "density": 3e-6, "quiet": 200000.0, "floor": 2.0, "quiet_burst": 3600.0, "places": 6}


def _loudness(s, d):
    return recordings(s, d).select("rec_id", "t", F.col("value").alias("level"))


@query("i04_sections")
def i04_full(s, d):
    return S.sections(recordings(s, d).select("rec_id", "t", "value"), _loudness(s, d), of_type(s, d, "click"), BY, "value", scale=0.5, margin=3.0, hold=200000.0, **_SETTINGS)


@query("i20_sections_sweep")
def i20_full(s, d):
    return S.sweep_sections(recordings(s, d).select("rec_id", "t", "value"), _loudness(s, d), of_type(s, d, "click"), of_type(s, d, "error"), BY, "value", [0.3, 0.6], [1.0, 5.0], [100000.0, 300000.0], 36000.0, **_SETTINGS)


@query("i11_gear_verdict")
def i11_verdict(s, d):
    return P.gear_verdict(items(s, d), levels(s, d), BY, 3600.0, 7200.0)


@query("i13_quality_header")
def i13_header(s, d):
    x = recordings(s, d).select("rec_id", F.col("value").alias("sharpness"), (F.col("value") / 1000).alias("clipped"), F.when(F.col("event_type") != "view", F.col("value") / 100).alias("stability"))
    return P.quality_header(x, BY, FLOORS).select("rec_id", F.round("sharpness", 6).alias("sharpness"), "failed", "misses", "samples", "unusable_share")


@query("i17_segment_histogram")
def i17_histogram(s, d):
    return P.segment_histogram(of_type(s, d, "view"), recordings(s, d).groupBy("rec_id").agg(F.min("t").alias("first"), F.max("t").alias("last")), BY, 3600.0)


@query("d33_gap_report")
def d33_gaps(s, d):
    from ..operators.aggregates import gap_report

    r = gap_report(recordings(s, d), BY, 172800.0)
    return r.withColumn("largest", F.array_join(F.transform("largest", lambda x: F.concat_ws(":", F.floor(x["t"]).cast("string"), F.floor(x["gap"]).cast("string"))), ","))


def _everything(s, d):
    e = recordings(s, d)
    views = P.grid_trust(of_type(s, d, "view").withColumn("day", F.floor(F.col("t") / 86400)), BY, "day")
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("t")).cast("long")
    bars = of_type(s, d, "purchase").select("rec_id", "t", n.alias("bar"), (F.pmod(n - 1, F.lit(4)) + 1).alias("in_group"))
    v, read = F.col("value"), F.col("event_id") % 5 != 0
    deltas = of_type(s, d, "error").select("rec_id", "t", F.when(read, v / 100).alias("delta"), F.when(read, v < 20).alias("jump"))
    graphics = items(s, d).where("value > 60").select("rec_id", F.col("t").alias("start"), (F.col("t") + 40000).alias("stop"), F.when(F.col("clip") == "view", "card").otherwise("overlay").alias("kind"))
    samples = e.select("rec_id", "t", v.alias("sharpness"), (v / 2).alias("exposure"), (v / 1000).alias("clipped"), F.when(F.col("event_type") != "view", v / 100).alias("stability"))
    return P.correlate_all(items(s, d), views, BY, "event_id", bars=bars, transients=of_type(s, d, "click"), sections=sections(s, d), changes=_changes(s, d), deltas=deltas, graphics=graphics, samples=samples, near=20000.0, guard=60.0, width=86400.0)


@query("i08_correlate_all")
def i08_all(s, d):
    places = {"offset": 3, "bar_offset": 3, "transient_offset": 3} | dict.fromkeys(("delta", "sharpness", "exposure", "clipped", "stability"), 6)
    r = _everything(s, d).select("event_id", *(F.round(c, n).alias(c) for c, n in places.items()), "opens", "stranded", "in_grid", "map_bar", "in_group", "section", "state", "jump", "straddles", "super_kind", "samples", "most")
    return r


@query("i09_correlate_all_summary")
def i09_all(s, d):
    """Means are given as totals, which every engine rounds alike."""
    r = P.correlate_all_summary(_everything(s, d), BY, 9)
    total = lambda mean, n: F.round(F.col(mean) * n, 3)
    return r.withColumns({"total": total("mean", F.col("measured")), "bar_total": total("bar_mean", F.col("items") - F.col("openings"))}).drop("mean", "bar_mean")
