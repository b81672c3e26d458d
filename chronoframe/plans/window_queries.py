"""Queries over windows (E) and islands (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import islands as I
from ..operators import windows as W
from .registry import items, levels, of_type, query, read, recordings, segments, sql

BY = ["rec_id"]
_W = "WINDOW w AS (PARTITION BY rec_id ORDER BY t)"


@query("e01_intervals", sql(f"+g AS (SELECT *, lead(t) OVER w - t AS gap FROM e {_W}) SELECT event_id, gap, t + coalesce(gap, median(gap) FILTER (WHERE gap > 0) OVER (PARTITION BY rec_id)) AS stop FROM g", "e"))
def e01(s, d):
    return W.intervals(recordings(s, d), BY).select("event_id", "gap", "stop")


_NINE = "g AS (SELECT *, lead(t) OVER w - t AS gap, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY t)), m AS (SELECT *, CASE WHEN rn < 5 THEN (SELECT median(h.gap) FROM g h WHERE h.rec_id = g.rec_id AND h.rn <= 9) ELSE median(gap) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) END AS m FROM g)"


@query("e02_steady_flags", sql(f"+{_NINE}, o AS (SELECT *, coalesce(abs(gap - m) > 0.15::DOUBLE * m, FALSE) AS off FROM m) SELECT event_id, count(gap) OVER (PARTITION BY rec_id) < 2 OR NOT (off OR coalesce(lag(off) OVER w, FALSE)) AS steady FROM o {_W}", "e"))
def e02(s, d):
    return W.steady_flags(recordings(s, d), BY).select("event_id", "steady")


@query("e03_local_spacing", sql(f"+{_NINE} SELECT event_id, round(CASE WHEN gap IS NOT NULL THEN m ELSE lag(m) OVER w END, 4) AS spacing FROM m {_W}", "e"))
def e03(s, d):
    return W.local_spacing(recordings(s, d), BY).select("event_id", F.round("spacing", 4).alias("spacing"))


@query("e04_moving_median", sql("SELECT event_id, round(median(value) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS smooth FROM e", "e"))
def e04(s, d):
    return W.moving_median(recordings(s, d), BY, "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("e05_levelled", sql("+i AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i FROM e), m AS (SELECT a.event_id, any_value(a.value) AS v, median(b.value) AS m FROM i a JOIN i b ON b.rec_id = a.rec_id AND b.i >= greatest(0, a.i - 16) AND b.i < greatest(0, a.i - 16) + 33 GROUP BY a.event_id) SELECT event_id, round(CASE WHEN m > 0 THEN v / m ELSE 0 END, 4) AS levelled FROM m", "e"))
def e05(s, d):
    return W.levelled(recordings(s, d), BY, "value").select("event_id", F.round("levelled", 4).alias("levelled"))


@query("e06_moving_mean_range", sql("SELECT event_id, round(avg(value) OVER (PARTITION BY rec_id ORDER BY round(t * 1000000)::BIGINT RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING), 6) AS mean FROM e", "e"))
def e06(s, d):
    return W.moving_mean_range(recordings(s, d), BY, "value", 86400.0).select("event_id", F.round("mean", 6).alias("mean"))


@query("e07_terciles", sql("+r AS (SELECT event_id, row_number() OVER (PARTITION BY rec_id ORDER BY value, t) - 1 AS r, count(*) OVER (PARTITION BY rec_id) AS n FROM e) SELECT event_id, CASE WHEN r < n // 3 THEN 'quiet' WHEN r >= 2 * n // 3 THEN 'loud' ELSE 'middle' END AS tercile FROM r", "e"))
def e07(s, d):
    return W.terciles(recordings(s, d), BY, "value").select("event_id", "tercile")


@query("e08_alternation_run", sql(f"+a AS (SELECT *, lag(event_type) OVER w AS one, lag(event_type, 2) OVER w AS two FROM e {_W}), b AS (SELECT *, coalesce(one <> event_type, FALSE) AS cut, coalesce(one <> event_type AND two = event_type, FALSE) AS goes FROM a), c AS (SELECT *, sum((NOT goes)::INT) OVER w AS i FROM b {_W}), r AS (SELECT rec_id, i, sum(cut::INT) AS n FROM c GROUP BY ALL), x AS (SELECT rec_id, max(n) AS n FROM r GROUP BY 1), y AS (SELECT rec_id, count(*) - 1 AS cuts FROM e GROUP BY 1) SELECT x.rec_id, CASE WHEN n >= 2 THEN n ELSE 0 END::BIGINT AS run, CASE WHEN cuts > 0 THEN round(CASE WHEN n >= 2 THEN n ELSE 0 END / cuts, 4) END AS share FROM x JOIN y USING (rec_id)", "e"))
def e08(s, d):
    return W.alternation_run(recordings(s, d), BY, "event_type")


@query("e09_monotone_run", sql(f"+a AS (SELECT *, sign(value - lag(value) OVER w) AS s FROM e {_W}), b AS (SELECT *, coalesce(s = lag(s) OVER w AND s <> 0, FALSE) AS goes FROM a {_W}), c AS (SELECT *, sum((NOT goes)::INT) OVER w AS i FROM b {_W}), r AS (SELECT rec_id, i, count(*) FILTER (WHERE s <> 0) AS n FROM c GROUP BY ALL) SELECT rec_id, CASE WHEN max(n) >= 4 THEN max(n) ELSE 0 END AS run FROM r GROUP BY 1", "e"))
def e09(s, d):
    return W.monotone_run(recordings(s, d), BY, "value")


@query("e10_opening_flag", sql("+i AS (SELECT *, lag(t_end) OVER (PARTITION BY rec_id ORDER BY t) AS b FROM items WHERE clip <> 'click') SELECT event_id, b IS NULL OR b <> t AS opens FROM i", "e", "items"))
def e10(s, d):
    i = items(s, d).where("clip <> 'click'").select("rec_id", "event_id", F.col("t").alias("start"), F.col("t_end").alias("stop"))
    return W.opening_flag(i, BY).select("event_id", "opens")


@query("e11_orphans", sql(f"+m AS (SELECT *, median(seconds) OVER (PARTITION BY rec_id) AS m FROM items) SELECT event_id, coalesce(seconds < m / 2 AND lag(seconds) OVER w >= m AND lead(seconds) OVER w >= m, FALSE) AS orphan FROM m {_W}", "e", "items"))
def e11(s, d):
    return W.orphans(items(s, d), BY, "seconds").select("event_id", "orphan")


@query("e12_number_groups", sql(f"+g AS (SELECT *, sum((event_type = 'view' OR rn = 1)::INT) OVER (PARTITION BY rec_id ORDER BY t)::BIGINT AS grp FROM (SELECT *, row_number() OVER w AS rn FROM e {_W})) SELECT event_id, grp, row_number() OVER (PARTITION BY rec_id, grp ORDER BY t) AS pos FROM g", "e"))
def e12(s, d):
    return W.number_groups(recordings(s, d), BY, F.col("event_type") == "view").select("event_id", "grp", "pos")


@query("e13_group_position", sql("SELECT p_partkey, (p_partkey + 3) % 4 + 1 AS pos FROM part"))
def e13(s, d):
    return read(s, d, "part").select("p_partkey", W.group_position(F.col("p_partkey")).alias("pos"))


@query("e14_sequential_layout", sql("SELECT doc, pos, start + 100 AS start, start + duration + 100 AS stop, sum(duration) OVER (PARTITION BY doc)::BIGINT AS total FROM segments", "segments"))
def e14(s, d):
    return W.sequential_layout(segments(s, d).drop("start"), ["doc"], origin=100).select("doc", "pos", "start", "stop", "total")


@query("e15_trend_residual", sql(f"+a AS (SELECT event_id, rec_id, t, (value - 20) / 10 AS dx, (value % 7) / 10 AS dy, event_type = 'signup' AS cut FROM e), b AS (SELECT *, sum(cut::INT) OVER (PARTITION BY rec_id ORDER BY t) AS i FROM a), c AS (SELECT *, avg(dx) OVER n AS mx, avg(dy) OVER n AS my FROM b WINDOW n AS (PARTITION BY rec_id, i, cut ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT event_id, CASE WHEN NOT cut THEN round(greatest(0, 1 - sqrt((dx - mx) ^ 2 + (dy - my) ^ 2) / (0.02::DOUBLE * 640)), 5) END AS stability FROM c", "e"))
def e15(s, d):
    v = F.col("value")
    x = recordings(s, d).select("event_id", "rec_id", "t", ((v - 20) / 10).alias("dx"), (v % 7 / 10).alias("dy"), (F.col("event_type") == "signup").alias("discontinuity"))
    return W.trend_residual(x, BY, 640.0).select("event_id", F.round("stability", 5).alias("stability"))


@query("e16_onset_peaks", sql(f"+m AS (SELECT *, median(value) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM e) SELECT event_id, coalesce(value > lag(value) OVER w AND value >= lead(value) OVER w AND value > greatest(1.5 * m, 0.2), FALSE) AS peak FROM m {_W}", "e"))
def e16(s, d):
    return W.onset_peaks(recordings(s, d), BY, "value").select("event_id", "peak")


_US = "PARTITION BY rec_id ORDER BY round(t * 1000000)::BIGINT RANGE BETWEEN {0}000000 PRECEDING AND {0}000000 FOLLOWING"


@query("e17_prominent_peaks", sql(f"+p AS (SELECT * FROM e QUALIFY value = max(value) OVER ({_US.format(86400)}) AND value - min(value) OVER ({_US.format(172800)}) >= 5), x AS (SELECT *, lag(t) OVER w AS x FROM p {_W}), i AS (SELECT *, sum((coalesce(t - x > 86400, TRUE))::INT) OVER w AS i FROM x {_W}) SELECT event_id FROM i QUALIFY row_number() OVER (PARTITION BY rec_id, i ORDER BY value DESC, t) = 1", "e"))
def e17(s, d):
    return W.prominent_peaks(recordings(s, d), BY, "value", 86400.0, 172800.0, 5.0).select("event_id")


@query("e18_step_change", sql(f"+m AS (SELECT *, row_number() OVER w AS n, median(value) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS b, median(value) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS a FROM e {_W}), h AS (SELECT *, abs(12 * log2(a / b)) AS step FROM m WHERE a > 0 AND b > 0), k AS (SELECT *, n - row_number() OVER (PARTITION BY rec_id ORDER BY t) AS i FROM h WHERE step >= 4) SELECT event_id, round(step, 4) AS step FROM k QUALIFY row_number() OVER (PARTITION BY rec_id, i ORDER BY step DESC, t) = 1", "e"))
def e18(s, d):
    return W.step_change(recordings(s, d), BY, "value", 6).select("event_id", F.round("step", 4).alias("step"))


@query("e19_rise_bonus", sql(f"+q AS (SELECT *, value / 100 AS a, quantile_cont(value / 100, 0.2) OVER (PARTITION BY rec_id) AS b FROM e) SELECT event_id, round(least(greatest((a - b) / 0.3::DOUBLE, 0), 1) + least(greatest(coalesce(a - lag(a) OVER w, 0), 0), 0.15::DOUBLE), 5) AS score FROM q {_W}", "e"))
def e19(s, d):
    return W.rise_bonus(recordings(s, d).withColumn("a", F.col("value") / 100), BY, "a").select("event_id", F.round("score", 5).alias("score"))


@query("e20_isolated_label_smooth", sql(f"SELECT event_id, CASE WHEN lag(event_type) OVER w = lead(event_type) OVER w AND event_type <> lag(event_type) OVER w AND event_type <> 'signup' THEN lag(event_type) OVER w ELSE event_type END AS smooth FROM e {_W}", "e"))
def e20(s, d):
    return W.isolated_label_smooth(recordings(s, d), BY, "event_type", "signup").select("event_id", "smooth")


@query("e21_local_baseline", sql(f"+x AS (SELECT *, row_number() OVER w AS n FROM e {_W}) SELECT a.event_id, round(median(b.value), 5) AS baseline FROM x a LEFT JOIN x b ON a.rec_id = b.rec_id AND abs(a.n - b.n) BETWEEN 3 AND 8 GROUP BY a.event_id", "e"))
def e21(s, d):
    return W.local_baseline_excluding(recordings(s, d), BY, "value", 8, 2).select("event_id", F.round("baseline", 5).alias("baseline"))


@query("e22_first_sustained", sql("+g AS (SELECT *, lead(t) OVER w - t AS gap, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY t)), k AS (SELECT rec_id, count(*) AS n, CASE WHEN median(gap) > 0 THEN greatest(round_even(200000 / median(gap), 0)::BIGINT, 1) END AS w FROM g GROUP BY 1), c AS (SELECT a.rec_id, a.t, any_value(w) AS w, sum((b.value >= 15)::INT) AS c FROM g a JOIN k ON k.rec_id = a.rec_id JOIN g b ON b.rec_id = a.rec_id AND b.i >= a.i AND b.i < a.i + w WHERE a.value >= 15 AND a.i + w - 1 <= n GROUP BY a.rec_id, a.t), m AS (SELECT rec_id, min(t) AS t FROM c WHERE c >= 0.75 * w GROUP BY 1) SELECT k.rec_id, coalesce(n >= 2 AND n >= w, FALSE) AS measured, t FROM k LEFT JOIN m USING (rec_id)", "e"))
def e22(s, d):
    return W.first_sustained(recordings(s, d), BY, "value", 15.0, 200000.0)


_WINDOWS = "u AS (SELECT *, round(t * 1000000)::BIGINT AS us FROM e), b AS (SELECT rec_id, min(us) AS f, max(us) AS l FROM u GROUP BY 1), k AS (SELECT rec_id, f, l, l - f < 86400000000 AS short, unnest(range(0, greatest((l - f - 86400000000) // 43200000000, 0) + 1)) AS k FROM b), h AS (SELECT u.*, (f + k * 43200000000) / 1000000 AS start, CASE WHEN short THEN (l - f) / 1000000 ELSE 86400 END AS span FROM k JOIN u ON u.rec_id = k.rec_id AND (short OR us >= f + k * 43200000000 AND us < f + k * 43200000000 + 86400000000))"


@query("e23_hopping_windows", sql(f"+{_WINDOWS} SELECT rec_id, round(start, 3) AS start, count(*) AS n, round(sum(value), 4) AS total FROM h GROUP BY rec_id, start", "e"))
def e23(s, d):
    return W.hopping_windows(recordings(s, d), BY, 86400.0, 43200.0).groupBy("rec_id", F.round("start", 3).alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("e24_tumbling_level", sql("SELECT rec_id, floor(t / 86400) * 86400 AS t, round(greatest(10 * log10(avg(value * value)), -120), 4) AS level FROM e GROUP BY rec_id, floor(t / 86400)", "e"))
def e24(s, d):
    return W.tumbling_level(recordings(s, d), BY, "value", 86400.0)


@query("e25_window_table", sql(f"+{_WINDOWS} SELECT rec_id, round(start, 3) AS start, round(10 * log10(avg(value * value / 4) + 1.41 * avg(value * value / 16)) - 0.691, 2) AS lufs, round(10 * log10(avg(value * value)), 2) AS rms, round(count(*) FILTER (WHERE event_type = 'click') / nullif(any_value(span), 0), 9) AS onsets FROM h GROUP BY rec_id, start", "e"))
def e25(s, d):
    v = F.col("value")
    t = W.window_table(recordings(s, d), BY, 86400.0, 43200.0, [v / 2, F.lit(0.0), F.lit(0.0), v / 4], v, F.col("event_type") == "click", floor=None)
    return t.withColumn("start", F.round("start", 3))


def _daily(s, d):
    return recordings(s, d).groupBy("rec_id", (F.floor(F.col("t") / 86400) * 86400).cast("double").alias("t"), "event_type").agg(F.round(F.sum("value"), 4).alias("lift"))


_DAILY = "dl AS (SELECT rec_id, floor(t / 86400) * 86400 AS t, event_type, round(sum(value), 4) AS lift FROM e GROUP BY rec_id, floor(t / 86400), event_type)"


@query("e26_leader", sql(f"+{_DAILY}, r AS (SELECT *, row_number() OVER x AS k, lead(lift) OVER x AS second FROM dl WINDOW x AS (PARTITION BY rec_id, t ORDER BY lift DESC, event_type DESC)) SELECT rec_id, t, CASE WHEN second IS NULL OR lift - second >= 5 THEN event_type END AS leader FROM r WHERE k = 1", "e"))
def e26(s, d):
    return W.leader(_daily(s, d), BY, "event_type", "lift", 5.0)


@query("e27_prominence", sql("SELECT event_id, round(least(greatest(value - greatest(quantile_cont(value, 0.05) OVER p, max(value) OVER p - 40), 0), 40), 5) AS lift FROM e WINDOW p AS (PARTITION BY rec_id)", "e"))
def e27(s, d):
    return W.prominence(recordings(s, d), BY, "value").select("event_id", F.round("lift", 5).alias("lift"))


@query("e28_close_runs", sql("SELECT event_id, t AS start, coalesce(lead(t) OVER (PARTITION BY rec_id ORDER BY t), (SELECT max(t) FROM e x WHERE x.rec_id = e.rec_id) + 1) AS stop FROM e WHERE event_type = 'purchase'", "e"))
def e28(s, d):
    ends = recordings(s, d).groupBy("rec_id").agg(F.max("t").alias("z"))
    p = of_type(s, d, "purchase").join(ends, "rec_id")
    return p.select("event_id", F.col("t").alias("start"), F.coalesce(F.lead("t").over(Window.partitionBy("rec_id").orderBy("t")), F.col("z") + 1).alias("stop"))


@query("e29_jump_seams", sql("SELECT doc, pos, coalesce(lag(source) OVER (PARTITION BY doc ORDER BY pos) = source, FALSE) AS jump FROM (SELECT doc, pos, source % 3 AS source FROM segments)", "segments"))
def e29(s, d):
    return W.jump_seams(segments(s, d).withColumn("source", F.col("source") % 3), ["doc"]).select("doc", "pos", "jump")


@query("e30_repeated_seam", sql("WITH k AS (SELECT conv_id, turn, list_transform(string_split(lower(text), ' ')[1:8], lambda w: w[1:1]) AS k FROM conversations), p AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM k) SELECT conv_id, turn, coalesce((SELECT max(n) FROM unnest(range(1, least(len(p), len(k)) + 1)) AS u(n) WHERE p[len(p) - n + 1:len(p)] = k[1:n]), 0) AS repeated FROM p"))
def e30(s, d):
    k = F.transform(F.slice(F.split(F.lower("text"), " "), 1, 8), lambda w: F.substring(w, 1, 1))
    return W.repeated_seam(read(s, d, "conversations").withColumn("k", k), ["conv_id"], "k", "turn").select("conv_id", "turn", F.col("repeated").cast("long").alias("repeated"))


def _wide(s, d):
    return recordings(s, d).select("rec_id", "event_id", "t", F.col("t").alias("start"), (F.col("t") + F.col("value") * 900).alias("stop"))


@query("e31_furthest_overlap", sql("+x AS (SELECT rec_id, event_id, t AS start, t + value * 900 AS stop FROM e), m AS (SELECT *, max((stop, -event_id)) OVER (PARTITION BY rec_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x) SELECT event_id, CASE WHEN m[1] > start THEN -m[2] END AS overlaps FROM m", "e"))
def e31(s, d):
    return W.furthest_overlap(_wide(s, d), BY, "event_id").select("event_id", "overlaps")


@query("e34_flux")
def e34(s, d):
    v = read(s, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return W.flux(v, ["label"], "vec", "vec_id").select("vec_id", F.round("flux", 4).alias("flux"))


@query("e33_blend_fit")
def e33(s, d):
    v = read(s, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return W.blend_fit(v, ["label"], "vec", "vec_id").select("vec_id", F.round("alpha", 4).alias("alpha"), F.round("residual", 4).alias("residual"))


@query("e35_best_window", sql("""+u AS (SELECT rec_id, round(t * 1000000)::BIGINT AS us, event_type AS k, value FROM e), b AS (SELECT rec_id, min(us) AS lo, max(us) AS hi FROM u GROUP BY 1),
    k AS (SELECT rec_id, lo + unnest(range(0, (hi - lo - 86400000000) // 43200000000 + 1)) * 43200000000 AS s FROM b WHERE lo + 86400000000 <= hi), p AS (SELECT rec_id, arg_max(us, (value, -us)) AS peak FROM u WHERE k = 'view' GROUP BY 1),
    w AS (SELECT k.rec_id, s, count(*) FILTER (WHERE k = 'error') AS changes, count(*) FILTER (WHERE k = 'purchase') AS strong, count(*) FILTER (WHERE k = 'click') AS weaker, max(value) FILTER (WHERE k = 'view') - min(value) FILTER (WHERE k = 'view') AS range FROM k LEFT JOIN u ON u.rec_id = k.rec_id AND us BETWEEN s AND s + 86400000000 GROUP BY k.rec_id, s),
    x AS (SELECT w.*, coalesce(peak BETWEEN s AND s + 86400000000, FALSE) AS peak FROM w LEFT JOIN p USING (rec_id)),
    y AS (SELECT rec_id, round(s / 1000000, 3) AS start, changes, strong, weaker, round(range, 2) AS range, peak, round(3.0::DOUBLE * changes + 0.1::DOUBLE * strong + 0.05::DOUBLE * weaker + 0.5::DOUBLE * coalesce(range, 0) / 6 + peak::INT, 3) AS score FROM x)
    SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, start) = 1""", "e"))
def e35(s, d):
    spans = recordings(s, d).groupBy("rec_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    rows = [of_type(s, d, k) for k in ("error", "purchase", "click")]
    best = W.best_window(spans, *rows, of_type(s, d, "view").withColumn("level", F.col("value")), BY, 86400.0, 43200.0)
    return best.withColumn("start", F.round("start", 3))


@query("e41_refine_boundary", sql("+s AS (SELECT rec_id, t, round(abs(avg(value) OVER (PARTITION BY rec_id ORDER BY round(t * 1000000)::BIGINT RANGE BETWEEN CURRENT ROW AND 43200000000 FOLLOWING) - avg(value) OVER (PARTITION BY rec_id ORDER BY round(t * 1000000)::BIGINT RANGE BETWEEN 43200000000 PRECEDING AND 1 PRECEDING)), 6) AS d FROM e) SELECT l.event_id, coalesce(arg_max(s.t, (d, -s.t)) FILTER (WHERE d IS NOT NULL), any_value(l.t)) AS refined FROM (SELECT * FROM e WHERE event_type = 'error') l LEFT JOIN s ON s.rec_id = l.rec_id AND abs(s.t - l.t) <= 86400 GROUP BY l.event_id", "e"))
def e41(s, d):
    return W.refine_boundary(recordings(s, d).select("rec_id", "t", F.col("value").alias("level")), of_type(s, d, "error").select("rec_id", "event_id", "t"), BY, "event_id", 86400.0, 43200.0).select("event_id", "refined")


_RUN = "z AS (SELECT *, value >= 20 AS on1, coalesce(lead(t) OVER w, 2 * t - lag(t) OVER w, t) AS t1 FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY t)), y AS (SELECT *, (on1 AND NOT coalesce(lag(on1) OVER w, FALSE))::INT AS nw FROM z WINDOW w AS (PARTITION BY rec_id ORDER BY t)), x AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY t) AS i FROM y), r AS (SELECT rec_id, min(t) AS start, max(t1) AS stop, count(*) AS rows, max(value) AS peak FROM x WHERE on1 GROUP BY rec_id, i)"
_MERGE = "mg AS (SELECT *, max(stop) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), mh AS (SELECT *, sum((coalesce(start - reach >= 7200, TRUE))::INT) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM mg), mm AS (SELECT rec_id, min(start) AS start, max(stop) AS stop, sum(rows)::BIGINT AS rows, max(peak) AS peak FROM mh GROUP BY rec_id, i)"


@query("f01_threshold_runs", sql(f"+{_RUN} SELECT * FROM r", "e"))
def f01(s, d):
    return I.threshold_runs(recordings(s, d), BY, "value", 20.0)


@query("f02_merge_gaps", sql(f"+{_RUN}, {_MERGE} SELECT * FROM mm", "e"))
def f02(s, d):
    return I.merge_gaps(I.threshold_runs(recordings(s, d), BY, "value", 20.0), BY, 7200.0)


@query("f03_bursts", sql(f"+{_RUN}, {_MERGE} SELECT * FROM mm WHERE stop - start >= 100000", "e"))
def f03(s, d):
    return I.bursts(recordings(s, d), BY, "value", 20.0, 7200.0, 100_000.0)


@query("f04_complement", sql(f"+{_RUN}, {_MERGE}, tt AS (SELECT rec_id, min(t) AS first, max(t) AS last FROM e GROUP BY 1), q AS (SELECT mm.*, first, last, lag(stop) OVER w AS p, lag(stop - start) OVER w AS pl, lead(start) OVER w AS nx FROM mm JOIN tt USING (rec_id) WINDOW w AS (PARTITION BY rec_id ORDER BY start)), o AS (SELECT rec_id, coalesce(p, first) AS a, start AS b, pl AS before, stop - start AS after FROM q UNION ALL SELECT rec_id, stop, last, stop - start, NULL FROM q WHERE nx IS NULL) SELECT rec_id, a AS start, b AS stop, before, after FROM o WHERE b - a >= 60", "e"))
def f04(s, d):
    e = recordings(s, d)
    return I.complement(I.merge_gaps(I.threshold_runs(e, BY, "value", 20.0), BY, 7200.0), e.groupBy("rec_id").agg(F.min("t").alias("first"), F.max("t").alias("last")), BY, 60.0)


@query("f05_below_runs", sql(f"+{_RUN.replace('value >= 20', 'value < 20')} SELECT rec_id, start, least(stop, 1705000000) AS stop, rows, peak FROM r WHERE least(stop, 1705000000) - start >= 3600", "e"))
def f05(s, d):
    return I.below_runs(recordings(s, d), BY, "value", 20.0, 3600.0, F.lit(1705000000.0))


@query("f06_merge_regions", sql("+z AS (SELECT *, value < 20 AS on1 FROM e), y AS (SELECT *, (on1 AND NOT coalesce(lag(on1) OVER w, FALSE))::INT AS nw FROM z WINDOW w AS (PARTITION BY rec_id ORDER BY t)), x AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY t) AS i FROM y) SELECT rec_id, min(t) AS first, max(t) AS last, count(*) AS n, string_agg(event_type, ' ' ORDER BY t) AS text FROM x WHERE on1 GROUP BY rec_id, i", "e"))
def f06(s, d):
    return I.merge_regions(recordings(s, d), BY, F.col("value") < 20, "t", "event_type")


_IDX = "ix AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS n FROM e)"


def _indexed(s, d):
    return recordings(s, d).withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("t")).cast("long"))


@query("f07_index_runs", sql(f"+{_IDX}, g AS (SELECT *, coalesce(n - lag(n) OVER w > 3, TRUE)::INT AS nw FROM ix WHERE value > 50 WINDOW w AS (PARTITION BY rec_id ORDER BY n)), h AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY n) AS i FROM g) SELECT rec_id, min(n) AS first, max(n) + 1 AS end, count(*) AS k FROM h GROUP BY rec_id, i", "e").replace("AS end", 'AS "end"'))
def f07(s, d):
    return I.index_runs(_indexed(s, d), BY, "n", F.col("value") > 50, 2).withColumnRenamed("n", "k")


@query("f08_bad_windows", sql(f"+{_IDX}, g AS (SELECT *, coalesce(n - lag(n) OVER w > 2, TRUE)::INT AS nw FROM ix WHERE value > 50 OR event_type = 'error' WINDOW w AS (PARTITION BY rec_id ORDER BY n)), h AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY n) AS i FROM g) SELECT rec_id, min(n) AS first, max(n) + 1 AS end, count(*) AS k, max(value) AS worst, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS reasons FROM h GROUP BY rec_id, i", "e").replace("AS end", 'AS "end"'))
def f08(s, d):
    aggs = [F.max("value").alias("worst"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("reasons")]
    return I.index_runs(_indexed(s, d), BY, "n", (F.col("value") > 50) | (F.col("event_type") == "error"), 1, aggs).withColumnRenamed("n", "k")


_HYS = "hy AS (SELECT *, coalesce(last_value(CASE WHEN value >= 50 THEN TRUE WHEN value < 15 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY t ROWS UNBOUNDED PRECEDING), FALSE) AS op FROM e)"


@query("f09_hysteresis_runs", sql(f"+{_HYS}, {_RUN.replace('value >= 20', 'op').replace('FROM e WINDOW', 'FROM hy WINDOW')} SELECT * FROM r", "e"))
def f09(s, d):
    return I.hysteresis_runs(recordings(s, d), BY, "value", 50.0, 15.0)


@query("f10_seed_and_grow", sql(f"+{_IDX}, g AS (SELECT *, coalesce(n - lag(n) OVER w > 2, TRUE)::INT AS nw FROM ix WHERE value > 15 WINDOW w AS (PARTITION BY rec_id ORDER BY n)), h AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY n) AS i FROM g) SELECT rec_id, min(n) AS first, max(n) + 1 AS end, count(*) AS k FROM h GROUP BY rec_id, i HAVING max(value) > 60", "e").replace("AS end", 'AS "end"'))
def f10(s, d):
    return I.seed_and_grow(_indexed(s, d), BY, "n", F.col("value") > 60, F.col("value") > 15, 1).withColumnRenamed("n", "k")


@query("f11_leader_runs")
def f11(s, d):
    return I.leader_runs(W.leader(_daily(s, d), BY, "event_type", "lift", 5.0), BY, 172800.0)


@query("f14_class_spans", sql(f"+c AS (SELECT *, coalesce(lag(event_type) OVER w = event_type, FALSE) AS same FROM e {_W}), f AS (SELECT * FROM c WHERE NOT same) SELECT rec_id, t AS start, coalesce(lead(t) OVER (PARTITION BY rec_id ORDER BY t), (SELECT max(t) FROM e x WHERE x.rec_id = f.rec_id)) AS stop, event_type AS label FROM f", "e"))
def f14(s, d):
    return I.class_spans(recordings(s, d), BY, "event_type")


@query("f15_segments_from_cuts", sql("+p AS (SELECT rec_id, unnest([min(t), max(t)]) AS t FROM e GROUP BY 1 UNION SELECT rec_id, t FROM e WHERE event_type = 'view') SELECT rec_id, t AS start, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS stop FROM p QUALIFY stop > start", "e"))
def f15(s, d):
    return I.segments_from_cuts(of_type(s, d, "view"), recordings(s, d).groupBy("rec_id").agg(F.min("t").alias("first"), F.max("t").alias("last")), BY)


@query("f16_top_layer", sql("+i AS (SELECT rec_id, event_id, t AS start, t + 600 + value * 300 AS stop, event_id % 3 AS layer FROM e), d AS (SELECT DISTINCT rec_id, unnest([start, stop]) AS start FROM i), c AS (SELECT rec_id, start, lead(start) OVER (PARTITION BY rec_id ORDER BY start) AS stop FROM d QUALIFY stop IS NOT NULL), b AS (SELECT c.rec_id, c.start, c.stop, arg_max(i.event_id, (layer, i.event_id)) AS k FROM c LEFT JOIN i ON i.rec_id = c.rec_id AND i.start < c.stop AND c.start < i.stop GROUP BY ALL), n AS (SELECT *, (NOT coalesce(lag(k) OVER w IS NOT DISTINCT FROM k AND lag(stop) OVER w IS NOT NULL, FALSE))::INT AS nw FROM b WINDOW w AS (PARTITION BY rec_id ORDER BY start)), m AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY start) AS x FROM n) SELECT rec_id, min(start) AS start, max(stop) AS stop, max(k) AS event_id, max(k) IS NULL AS black FROM m GROUP BY rec_id, x", "e"))
def f16(s, d):
    i = recordings(s, d).select("rec_id", "event_id", F.col("t").alias("start"), (F.col("t") + 600 + F.col("value") * 300).alias("stop"), (F.col("event_id") % 3).alias("layer"))
    return I.top_layer(i, BY, "event_id", 86400.0)


@query("f20_legs")
def f20(s, d):
    return I.legs(recordings(s, d), BY, "value", 25.0, chunk=604800.0)


@query("f23_moving_runs")
def f23(s, d):
    v = F.col("value")
    return I.moving_runs(recordings(s, d).select("rec_id", "t", ((v - 20) / 40).alias("dx"), (v % 7 / 10).alias("dy")), BY, 1.0, 60.0, 3600.0)


@query("g04_spaced_top_k")
def g04(s, d):
    return I.spaced_top_k(recordings(s, d), BY, "event_id", "value", 86400.0, 5)


@query("g05_thin", sql("+k AS (SELECT rec_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT k.rec_id, (SELECT min(e.t) FROM e WHERE e.rec_id = k.rec_id AND e.t - k.t >= 86400) AS t FROM k WHERE k.t IS NOT NULL) SELECT rec_id, t FROM k WHERE t IS NOT NULL", "e").replace("WITH", "WITH RECURSIVE", 1))
def g05(s, d):
    return I.thin(recordings(s, d), BY, 86400.0, chunk=604800.0)
