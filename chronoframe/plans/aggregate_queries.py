"""Queries over the aggregations (D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import items, levels, of_type, query, read, recordings, segments, sql
from .scalar_queries import FLOORS

BY = ["rec_id"]
TYPES = ["signup", "purchase", "error", "view", "click"]


@query("d01_offset_stats", sql("SELECT rec_id, count(o) AS measured, round(avg(abs(o)), 3) AS mean, round(median(abs(o)), 3) AS median, round(max(abs(o)), 3) AS worst, count(*) FILTER (WHERE o < 0) AS early, count(*) FILTER (WHERE o > 0) AS late, count(*) FILTER (WHERE o = 0) AS on FROM (SELECT rec_id, value - 50 AS o FROM e) GROUP BY 1", "e").replace("AS on FROM", 'AS "on" FROM'))
def d01(s, d):
    return A.offset_stats(recordings(s, d).withColumn("o", F.col("value") - 50), BY, "o")


@query("d02_histogram", sql("SELECT rec_id, event_type AS key, count(*) AS n FROM e GROUP BY ALL", "e"))
def d02(s, d):
    return A.histogram(recordings(s, d), BY, "event_type")


_BIN = "CASE WHEN h < 2 THEN '<2' WHEN h < 4 THEN '2-4' WHEN h < 8 THEN '4-8' WHEN h < 15 THEN '8-15' WHEN h < 30 THEN '15-30' ELSE '>30' END"
_BINS = "(SELECT unnest(['<2', '2-4', '4-8', '8-15', '15-30', '>30']) AS bin, unnest(range(6)) AS k)"


def _hours(s, d):
    return items(s, d).withColumn("h", F.col("seconds") / 3600)


@query("d03_binned_histogram", sql(f"SELECT rec_id, b.bin, count(*) FILTER (WHERE x = b.bin) AS n FROM (SELECT rec_id, {_BIN} AS x FROM (SELECT rec_id, seconds / 3600 AS h FROM items)), {_BINS} b GROUP BY ALL", "e", "items"))
def d03(s, d):
    return A.binned_histogram(_hours(s, d), BY, "h")


@query("d04_length_summary", sql("SELECT rec_id, round(avg(seconds), 3) AS mean, round(median(seconds), 3) AS median, round(min(seconds), 3) AS shortest, round(max(seconds), 3) AS longest FROM items GROUP BY 1", "e", "items"))
def d04(s, d):
    return A.length_summary(items(s, d), BY, "seconds")


@query("d05_usage", sql("SELECT rec_id, clip, rows, round(sec, 3) AS seconds, round(sec / sum(sec) OVER (PARTITION BY rec_id), 4) AS share FROM (SELECT rec_id, CASE WHEN clip = 'error' THEN 'unlabelled' ELSE clip END AS clip, count(*) AS rows, sum(seconds) AS sec FROM items GROUP BY ALL)", "e", "items"))
def d05(s, d):
    return A.usage(items(s, d).withColumn("clip", F.when(F.col("clip") != "error", F.col("clip"))), BY, "clip", "seconds")


@query("d06_spread", sql("SELECT rec_id, count(DISTINCT nullif(event_type, 'view')) AS covered, count(*) FILTER (WHERE event_type = 'view') AS outside FROM e GROUP BY 1", "e"))
def d06(s, d):
    return A.spread(recordings(s, d).withColumn("k", F.when(F.col("event_type") != "view", F.col("event_type"))), BY, "k")


@query("d07_cv", sql("SELECT rec_id, round(stddev_pop(value) / avg(value), 6) AS cv, round(CASE WHEN min(value) > 0 THEN max(value) / min(value) END, 4) AS ratio FROM e GROUP BY 1", "e"))
def d07(s, d):
    return recordings(s, d).groupBy("rec_id").agg(F.round(A.cv("value"), 6).alias("cv"), F.round(A.spread_ratio("value"), 4).alias("ratio"))


@query("d08_uniformity", sql(f"+b AS (SELECT rec_id, h, {_BIN} AS bin FROM (SELECT rec_id, seconds / 3600 AS h FROM items)), c AS (SELECT rec_id, bin, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT rec_id, count(h) AS n, round(stddev_pop(h) / avg(h), 4) AS cv FROM b GROUP BY 1) SELECT c.rec_id, arg_max(c.bin, (c.n, -k)) AS fullest, round(max(c.n) / any_value(t.n), 4) AS share, any_value(cv) AS cv FROM c JOIN {_BINS} o ON o.bin = c.bin JOIN t ON t.rec_id = c.rec_id GROUP BY c.rec_id", "e", "items"))
def d08(s, d):
    return A.uniformity(_hours(s, d), BY, "h")


@query("d09_quantile_summary", sql("SELECT rec_id, round(min(v), 4) AS low, round(quantile_cont(v, 0.1), 4) AS p10, round(median(v), 4) AS median, round(avg(v), 4) AS mean, round(max(v), 4) AS high, count(*) - count(v) AS unread FROM (SELECT rec_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM e) GROUP BY 1", "e"))
def d09(s, d):
    return A.quantile_summary(recordings(s, d).withColumn("v", F.when(F.col("event_type") != "view", F.col("value"))), BY, "v")


@query("d10_nearest_rank_spread", sql("SELECT rec_id, min(value) AS low, quantile_disc(value, 0.05) AS p05, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS high, round(quantile_disc(value, 0.05) / quantile_disc(value, 0.95), 6) AS ratio FROM e GROUP BY 1", "e"))
def d10(s, d):
    return A.nearest_rank_spread(recordings(s, d), BY, "value")


@query("d11_stretch_summary", sql("+x AS (SELECT rec_id, value AS sh, value / 1000 AS cl, CASE WHEN event_type <> 'view' THEN value / 100 END AS st FROM e), y AS (SELECT rec_id, median(sh) AS sh, max(cl) AS cl, min(st) AS st, count(*) FILTER (WHERE sh < 20 OR cl > 0.05 OR coalesce(st < 0.5, FALSE)) AS failed FROM x GROUP BY 1) SELECT rec_id, round(sh, 6) AS sharpness, failed, array_to_string(list_filter([CASE WHEN sh < 20 THEN 'soft' END, CASE WHEN cl > 0.05 THEN 'clipped' END, CASE WHEN st < 0.5 THEN 'shaky' END], lambda v: v IS NOT NULL), ',') AS misses FROM y", "e"))
def d11(s, d):
    x = recordings(s, d).select("rec_id", F.col("value").alias("sharpness"), (F.col("value") / 1000).alias("clipped"), F.when(F.col("event_type") != "view", F.col("value") / 100).alias("stability"))
    return A.stretch_summary(x, BY, FLOORS).select("rec_id", F.round("sharpness", 6).alias("sharpness"), "failed", "misses")


@query("d12_misses", sql("SELECT rec_id, count(*) AS n, list(event_id ORDER BY event_id)[1:12] AS ids FROM e WHERE value < 20 GROUP BY 1", "e"))
def d12(s, d):
    return A.misses(recordings(s, d), BY, "value", 20.0, "event_id")


@query("d13_covered_length", sql("+x AS (SELECT rec_id, t AS start, t + value * 900 AS stop FROM e), y AS (SELECT *, max(stop) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x) SELECT rec_id, round(sum(greatest(0, stop - greatest(start, coalesce(reach, start)))), 3) AS covered FROM y GROUP BY 1", "e"))
def d13(s, d):
    return A.covered_length(recordings(s, d).select("rec_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 900).alias("stop")), BY)


@query("d14_modal_size", sql("+g AS (SELECT rec_id, floor(t / 86400) AS day, count(*) AS size, min(t) AS t FROM e GROUP BY ALL), c AS (SELECT rec_id, size, count(*) AS n, min(t) AS f FROM g GROUP BY ALL) SELECT rec_id, arg_max(size, (n, -f)) AS size, round(max(n) / sum(n), 4) AS share, (max(n) >= 0.8 * sum(n) AND arg_max(size, (n, -f)) >= 2) AS committed FROM c GROUP BY 1", "e"))
def d14(s, d):
    return A.modal_size(recordings(s, d).withColumn("day", F.floor(F.col("t") / 86400)), BY, "day")


@query("d15_tempo_gist", sql("+g AS (SELECT rec_id, t, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS gap FROM e) SELECT rec_id, round(median(60 / gap), 6) AS median, round(min(60 / gap), 6) AS slowest, round(max(60 / gap), 6) AS fastest, count(*) AS n, min(t) AS first, max(t) AS last FROM g GROUP BY 1", "e"))
def d15(s, d):
    return A.tempo_gist(recordings(s, d), BY)


@query("d16_extremes", sql("SELECT rec_id, arg_max(event_id, (value, -event_id)) AS most, arg_min(event_id, (value, event_id)) AS least, count(*) AS n, round(avg(value), 4) AS mean FROM e GROUP BY 1", "e"))
def d16(s, d):
    return A.extremes(recordings(s, d), BY, "event_id", "value")


@query("d17_gated_mean", sql("+p AS (SELECT rec_id, value - 90 AS l, 10 ^ ((value - 90) / 10) AS p FROM e WHERE value - 90 > -70), q AS (SELECT *, avg(p) OVER (PARTITION BY rec_id) AS m FROM p) SELECT rec_id, round(10 * log10(coalesce(avg(p) FILTER (WHERE l > 10 * log10(m) - 10), avg(p))), 4) AS gated FROM q GROUP BY 1", "e"))
def d17(s, d):
    return A.gated_mean(recordings(s, d).withColumn("l", F.col("value") - 90), BY, "l")


@query("d18_transcript_stats", sql("SELECT rec_id, count(*) AS words, round(avg(value / 100), 4) AS confidence, count(*) FILTER (WHERE value / 100 < 0.5) AS low, round(sum(seconds), 3) AS speech, round(60 * count(*) / (max(t_end) - min(t)), 4) AS per_minute FROM items GROUP BY 1", "e", "items"))
def d18(s, d):
    w = items(s, d).select("rec_id", F.col("t").alias("start"), F.col("t_end").alias("stop"), (F.col("value") / 100).alias("confidence"))
    return A.transcript_stats(w, BY, 0.5)


@query("d19_reason_counts", sql("SELECT rec_id, reason, count(*) AS n FROM (SELECT rec_id, unnest(list_filter([CASE WHEN value < 20 THEN 'soft' END, CASE WHEN value > 50 THEN 'clipped' END, CASE WHEN value < 10 THEN 'dark' END], lambda v: v IS NOT NULL)) AS reason FROM e) GROUP BY ALL", "e"))
def d19(s, d):
    v = F.col("value")
    r = F.array_compact(F.array(F.when(v < 20, "soft"), F.when(v > 50, "clipped"), F.when(v < 10, "dark")))
    return A.reason_counts(recordings(s, d).withColumn("reasons", r), BY, "reasons")


@query("d20_share_summary", sql("+x AS (SELECT rec_id, CASE WHEN clip = 'error' THEN 'black' ELSE clip END AS label, sum(seconds) AS sec, count(*) FILTER (WHERE value > 50) AS verdicts FROM items GROUP BY ALL) SELECT rec_id, label, round(sec, 2) AS seconds, CASE WHEN label <> 'black' THEN round(sec / sum(sec) FILTER (WHERE label <> 'black') OVER (PARTITION BY rec_id), 4) END AS share, verdicts FROM x", "e", "items"))
def d20(s, d):
    x = items(s, d).select("rec_id", F.when(F.col("clip") == "error", "black").otherwise(F.col("clip")).alias("label"), "seconds", (F.col("value") > 50).alias("verdict"))
    return A.share_summary(x, BY)


@query("d21_detection_gist", sql("SELECT rec_id, count(*) AS considered, count(*) FILTER (WHERE value >= 35) AS kept, count(*) FILTER (WHERE value < 35) AS below, round(avg(value) FILTER (WHERE value >= 35), 4) AS mean, arg_max(event_id, (value, -event_id)) AS strongest FROM e GROUP BY 1", "e"))
def d21(s, d):
    return A.detection_gist(recordings(s, d), BY, "event_id", "value", 35.0)


@query("d22_seconds_by_class", sql("SELECT rec_id, " + ", ".join(f"round(coalesce(sum(seconds) FILTER (WHERE clip = '{c}'), 0), 3) AS {c}" for c in TYPES) + ", arg_max(clip, t) AS last, count(*) AS spans FROM items GROUP BY 1", "e", "items"))
def d22(s, d):
    return A.seconds_by_class(items(s, d).select("rec_id", F.col("t").alias("start"), F.col("t_end").alias("stop"), F.col("clip").alias("label")), BY, TYPES)


@query("d23_motion_summary", sql("+x AS (SELECT rec_id, (value - 20) / 10 AS dx, (value % 7) - 3 AS dy FROM e), y AS (SELECT rec_id, count(*) AS n, avg((sqrt(dx * dx + dy * dy) >= 1)::INT) AS share, sqrt(sum(dx) ^ 2 + sum(dy) ^ 2) AS net, sum(sqrt(dx * dx + dy * dy)) AS path FROM x GROUP BY 1) SELECT rec_id, n, round(share, 4) AS share, round(net, 3) AS net, round(path, 3) AS path, CASE WHEN n < 3 THEN 'unknown' WHEN share < 0.3 THEN 'still' WHEN net / path >= 0.6 THEN 'directed' ELSE 'wandering' END AS kind FROM y", "e"))
def d23(s, d):
    v = F.col("value")
    return A.motion_summary(recordings(s, d).select("rec_id", ((v - 20) / 10).alias("dx"), (v % 7 - 3).alias("dy")), BY)


@query("d24_latest_per_base", sql("SELECT p_type, arg_max(p_partkey, (coalesce(v, -1), -p_partkey)) AS p_partkey, max(v) AS v FROM (SELECT p_type, p_partkey, CASE WHEN p_size > 5 THEN p_size END AS v FROM part) GROUP BY 1"))
def d24(s, d):
    return A.latest_per_base(read(s, d, "part").withColumn("v", F.when(F.col("p_size") > 5, F.col("p_size"))), "p_type", "v", "p_partkey")


@query("d25_held_level", sql("+c AS (SELECT rec_id, value, sum(seconds) OVER (PARTITION BY rec_id ORDER BY value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM items) SELECT rec_id, coalesce(max(value) FILTER (WHERE c >= 500000), min(value)) AS held FROM c GROUP BY 1", "e", "items"))
def d25(s, d):
    return A.held_level(items(s, d), BY, "value", "seconds", 500_000.0)


@query("d26_seconds_over", sql("+x AS (SELECT rec_id, value, coalesce(lead(t) OVER w - t, t - lag(t) OVER w, 0) AS step FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY t)) SELECT rec_id, round(coalesce(sum(step) FILTER (WHERE value >= 40), 0), 3) AS over FROM x GROUP BY 1", "e").replace("AS over FROM", 'AS "over" FROM'))
def d26(s, d):
    return A.seconds_over(recordings(s, d), BY, "value", 40.0)


@query("d27_ordered_digest", sql("SELECT doc, sha256(string_agg(part || '@' || start || '@' || duration, ';' ORDER BY pos)) AS digest FROM segments GROUP BY doc", "segments"))
def d27(s, d):
    return A.ordered_digest(segments(s, d), ["doc"], ["part", "start", "duration"], ["pos"])


@query("d28_outside_count", sql("+g AS (SELECT rec_id, min(t) AS a, max(t) AS z FROM e WHERE event_type = 'view' GROUP BY 1) SELECT e.rec_id, count(*) FILTER (WHERE a IS NULL OR t < a OR t > z) AS outside FROM e LEFT JOIN g ON e.rec_id = g.rec_id GROUP BY 1", "e"))
def d28(s, d):
    return A.outside_count(recordings(s, d), of_type(s, d, "view"), BY)


@query("d29_class_counts", sql("SELECT rec_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{c}') AS {c}" for c in TYPES) + " FROM e GROUP BY 1", "e"))
def d29(s, d):
    return A.class_counts(recordings(s, d), BY, "event_type", TYPES)


@query("d30_contrast", sql("SELECT rec_id, round(coalesce((avg(value) FILTER (WHERE event_type = 'view') - avg(value) FILTER (WHERE event_type <> 'view')) / nullif(stddev_pop(value), 0), 0), 6) AS contrast FROM e GROUP BY 1", "e"))
def d30(s, d):
    return recordings(s, d).groupBy("rec_id").agg(F.round(A.contrast("value", F.col("event_type") == "view"), 6).alias("contrast"))


@query("d31_recommend_threshold", sql("SELECT rec_id, round(least(greatest(floor(min(value) * 0.8::DOUBLE / 0.25) * 0.25, 0.5), 9), 6)::DOUBLE AS threshold FROM e GROUP BY 1", "e"))
def d31(s, d):
    return recordings(s, d).groupBy("rec_id").agg(F.round(A.recommend_threshold("value", 0.8, 0.25, 0.5, 9.0), 6).alias("threshold"))


@query("d32_markers_by_name", sql("SELECT rec_id, event_type, list(event_id ORDER BY event_id) AS frames FROM e GROUP BY ALL", "e"))
def d32(s, d):
    return A.markers_by_name(recordings(s, d), BY, "event_type", "event_id")


@query("d33_grid_report", sql("+g AS (SELECT rec_id, floor(t / 86400)::BIGINT AS bin, lead(t) OVER (PARTITION BY rec_id ORDER BY t) - t AS gap FROM e), c AS (SELECT rec_id, bin, count(*) AS n, round(median(gap), 3) AS gap FROM g GROUP BY ALL), a AS (SELECT rec_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM c GROUP BY rec_id) SELECT a.rec_id, a.bin, coalesce(n, 0) AS rows, gap FROM a LEFT JOIN c ON a.rec_id = c.rec_id AND a.bin = c.bin", "e"))
def d33(s, d):
    return A.grid_report(recordings(s, d), BY, 86400.0)
