"""Queries over the joins (C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import similarity as S
from .registry import items, of_type, query, read, recordings, sections, sql

BY = ["rec_id"]
HOUR = 3600.0


def _err(s, d):
    return of_type(s, d, "error").select("rec_id", "event_id", "t")


def _views(s, d):
    return of_type(s, d, "view").select("rec_id", "t", F.col("event_id").alias("id"))


def _spans(s, d):
    return items(s, d).where("value > 60").select("rec_id", F.col("t").alias("start"), F.col("t_end").alias("stop"), F.col("event_id").alias("span"), F.when(F.col("clip") == "view", "card").otherwise("overlay").alias("kind"), F.col("clip").alias("label"))


_L = "l AS (SELECT rec_id, event_id, t FROM e WHERE event_type = 'error'), r AS (SELECT rec_id, t, event_id AS id FROM e WHERE event_type = 'view')"
_SP = "sp AS (SELECT rec_id, t AS start, t_end AS stop, event_id AS span, CASE WHEN clip = 'view' THEN 'card' ELSE 'overlay' END AS kind, clip AS label FROM items WHERE value > 60)"
_NEAR = "(SELECT r.{c} FROM r WHERE r.rec_id = l.rec_id ORDER BY abs(r.t - l.t), r.t LIMIT 1)"


@query("c01_nearest_join", sql(f"+{_L} SELECT event_id, {_NEAR.format(c='id')} AS id, round(t - {_NEAR.format(c='t')}, 3) AS off FROM l", "e"))
def c01(s, d):
    return J.nearest_join(_err(s, d), _views(s, d), BY, ["id"]).select("event_id", F.col("r_id").alias("id"), F.round("offset", 3).alias("off"))


@query("c02_nearest_within", sql(f"+{_L} SELECT event_id, CASE WHEN abs(t - {_NEAR.format(c='t')}) <= 36000 THEN {_NEAR.format(c='id')} END AS id FROM l", "e"))
def c02(s, d):
    return J.nearest_join(_err(s, d), _views(s, d), BY, ["id"], within=36000, chunk=86400.0).select("event_id", F.col("r_id").alias("id"))


@query("c03_asof_join", sql(f"+{_L} SELECT l.event_id, r.id FROM l ASOF LEFT JOIN r ON l.rec_id = r.rec_id AND l.t >= r.t", "e"))
def c03(s, d):
    return J.asof_join(_err(s, d), _views(s, d), BY, ["id"], chunk=86400.0).select("event_id", F.col("r_id").alias("id"))


_CH = "ch AS (SELECT rec_id, t, lag(k) OVER (PARTITION BY rec_id ORDER BY t) AS was, k AS \"to\" FROM (SELECT rec_id, t, CASE WHEN value > 20 THEN event_id::VARCHAR END AS k FROM e WHERE event_type = 'purchase'))"


@query("c04_state_asof", sql(f"+{_L}, {_CH} SELECT event_id, coalesce((SELECT \"to\" FROM ch WHERE ch.rec_id = l.rec_id AND ch.t <= l.t AND \"to\" IS NOT NULL ORDER BY ch.t DESC LIMIT 1), (SELECT coalesce(was, 'open') FROM ch WHERE ch.rec_id = l.rec_id ORDER BY ch.t LIMIT 1)) AS state FROM l", "e"))
def c04(s, d):
    p = of_type(s, d, "purchase").withColumn("to", F.when(F.col("value") > 20, F.col("event_id").cast("string")))
    w = Window.partitionBy("rec_id").orderBy("t")
    ch = p.select("rec_id", "t", F.coalesce(F.lag("to").over(w), F.when(F.row_number().over(w) == 1, "open")).alias("was"), "to")
    return J.state_asof(_err(s, d), ch, BY).select("event_id", "state")


@query("c05_window_at", sql(f"+{_L}, w AS (SELECT rec_id, t, id, coalesce(lead(t) OVER (PARTITION BY rec_id ORDER BY t), t + 3600) AS stop FROM r) SELECT event_id, (SELECT id FROM w WHERE w.rec_id = l.rec_id AND w.t <= l.t AND l.t < w.stop) AS id FROM l", "e"))
def c05(s, d):
    return J.window_at(_err(s, d), _views(s, d), BY, HOUR, ["id"]).select("event_id", F.col("r_id").alias("id"))


@query("c06_forward_or_nearest", sql(f"+{_L}, x AS (SELECT *, (SELECT min(r.t) FROM r WHERE r.rec_id = l.rec_id AND r.t >= l.t AND r.t <= l.t + 7200) AS f, {_NEAR.format(c='t')} AS n FROM l) SELECT event_id, coalesce(f, CASE WHEN abs(n - t) <= 36000 THEN n END, t) AS at, coalesce(f, CASE WHEN abs(n - t) <= 36000 THEN n END) IS NOT NULL AS snapped FROM x", "e"))
def c06(s, d):
    return J.forward_or_nearest(_err(s, d), _views(s, d), BY, 36000, F.col("t") + 7200).select("event_id", "at", "snapped")


@query("c07_point_in_interval", sql(f"+{_SP}, q AS (SELECT rec_id, event_id, t + 600 AS t FROM e) SELECT event_id, span FROM q LEFT JOIN sp ON q.rec_id = sp.rec_id AND start <= t AND t < stop", "e", "items"))
def c07(s, d):
    p = recordings(s, d).select("rec_id", "event_id", (F.col("t") + 600).alias("t"))
    return J.point_in_interval(p, _spans(s, d), BY, ["span"]).select("event_id", F.col("r_span").alias("span"))


@query("c08_straddle_join", sql(f"+{_SP}, q AS (SELECT rec_id, event_id, t + 600 AS t FROM e), h AS (SELECT event_id, arg_min(kind, (kind <> 'card', start)) AS kind FROM q JOIN sp ON q.rec_id = sp.rec_id AND start - 7200 + 60 < t AND t < stop + 7200 - 60 GROUP BY event_id) SELECT event_id, kind IS NOT NULL AS straddles, kind FROM q LEFT JOIN h USING (event_id)", "e", "items"))
def c08(s, d):
    p = recordings(s, d).select("rec_id", "event_id", (F.col("t") + 600).alias("t"))
    sp = _spans(s, d).withColumns({"start": F.col("start") - 7200, "stop": F.col("stop") + 7200})
    return J.straddle_join(p, sp, BY, "event_id", 86400.0, 60.0).select("event_id", "straddles", "kind")


@query("c09_straddle_pairs", sql(f"+{_SP}, {_L} SELECT span, event_id, round(t - start, 3) AS into_it, round(stop - t, 3) AS left_of_it FROM sp JOIN l ON sp.rec_id = l.rec_id AND start < t AND t < stop", "e", "items"))
def c09(s, d):
    return J.points_in_spans(_err(s, d), _spans(s, d).select("rec_id", F.col("start"), "stop", "span"), BY, 86400.0, 0.0).select("span", "event_id", F.round(F.col("t") - F.col("start"), 3).alias("into_it"), F.round(F.col("stop") - F.col("t"), 3).alias("left_of_it"))


_DAY = "dy AS (SELECT rec_id, floor(t / 86400) * 86400 AS start, floor(t / 86400) * 86400 + 86400 AS stop, floor(t / 86400)::BIGINT AS day FROM e GROUP BY ALL)"


def _days(s, d):
    day = F.floor(F.col("t") / 86400)
    return recordings(s, d).select("rec_id", (day * 86400).cast("double").alias("start"), (day * 86400 + 86400).cast("double").alias("stop"), day.alias("day")).distinct()


@query("c10_overlap_split", sql(f"+{_DAY}, p AS (SELECT dy.rec_id, day, clip AS label, round(sum(least(stop, t_end) - greatest(start, t)), 3) AS seconds, min(greatest(start, t)) AS f FROM dy JOIN items i ON i.rec_id = dy.rec_id AND i.t < stop AND start < i.t_end GROUP BY ALL) SELECT rec_id, day, label, seconds, row_number() OVER (PARTITION BY rec_id, day ORDER BY seconds DESC, f, label) = 1 AS verdict FROM p", "e", "items"))
def c10(s, d):
    i = items(s, d).select("rec_id", F.col("t").alias("start"), F.col("t_end").alias("stop"), F.col("clip").alias("label"))
    return J.overlap_split(_days(s, d), i, BY, "day", 86400.0)


@query("c11_range_agg_join", sql(f"+{_SP} SELECT span, count(e.t) AS n, round(max(e.value), 6) AS top FROM sp LEFT JOIN e ON e.rec_id = sp.rec_id AND start <= e.t AND e.t < stop GROUP BY span", "e", "items"))
def c11(s, d):
    return J.range_agg(_spans(s, d), recordings(s, d).select("rec_id", "t", "value"), BY, "span", 86400.0, [F.round(F.max("value"), 6).alias("top")]).select("span", "n", "top")


@query("c12_max_overlap", sql(f"+{_DAY} SELECT dy.rec_id, day, arg_max(i.event_id, (least(stop, t_end) - greatest(start, t), -t)) AS item FROM dy LEFT JOIN items i ON dy.rec_id = i.rec_id AND i.t < stop AND start < i.t_end GROUP BY dy.rec_id, day", "e", "items"))
def c12(s, d):
    i = items(s, d).select("rec_id", F.col("t").alias("start"), F.col("t_end").alias("stop"), F.col("event_id").alias("item"))
    return J.max_overlap(_days(s, d), i, BY, "day", "item", 86400.0).select("rec_id", "day", "item")


@query("c13_clip_to_window", sql("SELECT event_id, round(greatest(t - 1704153600, 0), 3) AS in_at, round(least(t_end - 1704153600, 86400), 3) AS in_end, (t >= 1704153600 AND t_end - 1704153600 <= 86400) AS whole FROM items WHERE t_end > 1704153600 AND t < 1704240000", "e", "items"))
def c13(s, d):
    i = items(s, d).select("event_id", F.col("t").alias("start"), F.col("t_end").alias("stop"))
    return J.clip_to_window(i, F.lit(1704153600.0), 86400.0).select("event_id", F.round("in_at", 3).alias("in_at"), F.round("in_end", 3).alias("in_end"), "whole")


@query("c14_resolve_unique", sql("WITH t AS (SELECT p_brand, p_size, count(*) AS matches, min(p_partkey) AS k FROM part GROUP BY ALL) SELECT s_suppkey, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN k END AS p_partkey FROM supplier LEFT JOIN t ON p_brand = 'Brand#' || (s_suppkey % 6) AND p_size = s_nationkey"))
def c14(s, d):
    refs = read(s, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 6).cast("string")).alias("p_brand"), F.col("s_nationkey").alias("p_size"))
    return J.resolve_unique(refs, read(s, d, "part"), ["p_brand", "p_size"], "p_partkey").select("s_suppkey", "matches", "p_partkey")


@query("c15_keep_named", sql("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"))
def c15(s, d):
    return J.keep_named(read(s, d, "customer"), read(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey").select("c_custkey")


@query("c16_anchored", sql(f"+{_L}, sx AS (SELECT section, start FROM sections) SELECT event_id, start + 5 AS at FROM l LEFT JOIN sx ON section = event_id - 1", "e", "sections"))
def c16(s, d):
    kids = _err(s, d).select("event_id", (F.col("event_id") - 1).alias("section"), F.lit(5.0).alias("offset"))
    return J.anchored(kids, sections(s, d), ["section"]).select("event_id", "at")


@query("c17_undeclared", sql("SELECT DISTINCT 'unused' AS what, p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT DISTINCT 'undeclared', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"))
def c17(s, d):
    used = read(s, d, "lineitem").select(F.col("l_partkey").alias("k"))
    unused = J.undeclared(read(s, d, "part").select(F.col("p_partkey").alias("k")), used, "k").select(F.lit("unused").alias("what"), "k")
    cust = read(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return unused.union(J.undeclared(read(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), cust, "k").select(F.lit("undeclared"), "k"))


@query("c18_clearance", sql(f"+{_SP}, {_L} SELECT span, round((SELECT min(l.t) FROM l WHERE l.rec_id = sp.rec_id AND l.t > stop) - stop, 3) AS clearance FROM sp", "e", "items"))
def c18(s, d):
    return J.clearance(_spans(s, d), _err(s, d), BY).select("span", F.round("clearance", 3).alias("clearance"))


@query("c19_coincidence", sql("SELECT a.event_id, count(DISTINCT b.event_type) FILTER (WHERE b.event_type <> a.event_type) AS agree, round(least(0.2::DOUBLE * count(DISTINCT b.event_type) FILTER (WHERE b.event_type <> a.event_type), 0.4::DOUBLE), 3) AS bonus FROM e a JOIN e b ON a.rec_id = b.rec_id AND b.t BETWEEN a.t - 21600 AND a.t + 21600 GROUP BY a.event_id", "e"))
def c19(s, d):
    return J.coincidence(recordings(s, d), BY, 21600.0, "event_type").select("event_id", F.col("agree").cast("long").alias("agree"), F.round("bonus", 3).alias("bonus"))


@query("c20_clock_align", sql("+z AS (SELECT doc, arg_min(start - part % 50, (source <> 7, start)) AS zero, bool_or(source = 7) AS matched FROM segments GROUP BY doc) SELECT doc, pos, matched, round((start - zero) / 25.0, 6)::DOUBLE AS clock FROM segments JOIN z USING (doc)", "segments"))
def c20(s, d):
    from .registry import segments

    i = segments(s, d).withColumns({"clip": F.col("source").cast("string"), "source_in": F.col("part") % 50})
    return J.clock_align(i, ["doc"], "7", 25.0).select("doc", "pos", "matched", F.round("clock", 6).alias("clock"))


@query("c21_single_anchor", sql("SELECT doc, CASE WHEN count(DISTINCT flag) = 1 THEN min(flag) END AS flag FROM segments GROUP BY doc", "segments"))
def c21(s, d):
    from .registry import segments

    return J.single_anchor(segments(s, d), ["doc"], "flag")


@query("c22_carry_annotations", sql("+a AS (SELECT doc, min(part) AS o, min(source) AS n FROM segments WHERE flag = 'N' GROUP BY doc) SELECT doc, pos, start + n - o AS moved, CASE WHEN o IS NULL THEN 'no shared anchor' END AS reason FROM segments LEFT JOIN a USING (doc)", "segments"))
def c22(s, d):
    from .registry import segments

    g = segments(s, d)
    z = lambda c: g.where("flag = 'N'").groupBy("doc").agg(F.min(c).alias("zero"))
    return J.carry_annotations(g.select("doc", "pos", F.col("start").alias("frame")), z("part"), z("source"), ["doc"]).select("doc", "pos", "moved", "reason")


@query("c23_exists_near", sql(f"+{_L} SELECT event_id, EXISTS (SELECT 1 FROM r WHERE r.rec_id = l.rec_id AND abs(r.t - l.t) <= 18000) AS near FROM l", "e"))
def c23(s, d):
    return J.exists_near(_err(s, d), _views(s, d), BY, 18000.0).select("event_id", "near")


@query("c24_count_in", sql(f"+{_DAY}, {_L} SELECT dy.rec_id, day, count(l.t)::BIGINT AS n, round(count(l.t) / 86400.0, 9)::DOUBLE AS density FROM dy LEFT JOIN l ON l.rec_id = dy.rec_id AND start <= l.t AND l.t < stop GROUP BY ALL", "e"))
def c24(s, d):
    return J.count_in(_days(s, d), _err(s, d), BY, "day").select("rec_id", "day", F.col("n").cast("long").alias("n"), F.round("density", 9).alias("density"))


@query("c25_covering", sql("+q AS (SELECT rec_id, t + 60 AS start, t + 4000 AS stop, event_id AS id FROM e WHERE event_type = 'click') SELECT id, max(event_id) AS item FROM q LEFT JOIN items i ON i.rec_id = q.rec_id AND i.t <= start AND i.t_end >= stop GROUP BY id", "e", "items"))
def c25(s, d):
    q = of_type(s, d, "click").select("rec_id", (F.col("t") + 60).alias("start"), (F.col("t") + 4000).alias("stop"), F.col("event_id").alias("id"))
    i = items(s, d).select("rec_id", F.col("t").alias("start"), F.col("t_end").alias("stop"), F.col("event_id").alias("item"))
    return J.covering(q, i, BY, "id", "item").select("id", "item")


@query("c26_snap_targets", sql(f"+{_L} SELECT event_id, round(floor(round((CASE WHEN abs(t - {_NEAR.format(c='t')}) <= 36000 THEN {_NEAR.format(c='t')} ELSE t END - 0.5::DOUBLE) * 25, 9)) / 25, 6) AS snapped FROM l", "e"))
def c26(s, d):
    return J.snap_targets(_err(s, d), _views(s, d), BY, 36000.0, 0.5, 25.0).select("event_id", F.round("snapped", 6).alias("snapped"))


@query("c27_match_truth", sql(f"+{_L}, x AS (SELECT rec_id, abs(t - {_NEAR.format(c='t')}) AS err FROM l), y AS (SELECT r.rec_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.rec_id = r.rec_id AND abs(l.t - r.t) <= 36000)) AS invented FROM r GROUP BY 1) SELECT x.rec_id, count(*) AS truths, count(*) FILTER (WHERE err <= 36000) AS matched, coalesce(any_value(invented), 0) AS invented, CASE WHEN count(*) = count(*) FILTER (WHERE err <= 36000) THEN round(max(err), 3) END AS worst FROM x LEFT JOIN y USING (rec_id) GROUP BY 1", "e"))
def c27(s, d):
    return J.match_truth(_views(s, d), _err(s, d), BY, 36000.0)


def _bins(s, d, kind):
    return of_type(s, d, kind).groupBy("rec_id", F.floor(F.col("t") / 86400).alias("bin")).agg(F.count("*").cast("double").alias("v"))


@query("c28_lag_align", sql("+b AS (SELECT rec_id, event_type AS k, floor(t / 86400)::BIGINT AS bin, count(*)::DOUBLE AS v FROM e GROUP BY ALL), c AS (SELECT a.rec_id, g.lag, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM b a, b, (SELECT unnest(range(-3, 4)) AS lag) g WHERE a.k = 'click' AND b.k = 'view' AND a.rec_id = b.rec_id AND b.bin = a.bin + g.lag GROUP BY ALL) SELECT rec_id, arg_max(lag, (r, -abs(lag), lag)) AS lag, max(r) AS r FROM c WHERE n >= 3 AND r IS NOT NULL AND NOT isnan(r) GROUP BY rec_id", "e"))
def c28(s, d):
    return S.lag_align(_bins(s, d, "click"), _bins(s, d, "view"), BY, 3)


@query("c29_section_rollup", sql("SELECT s.rec_id, section, count(*) AS n, round(avg(seconds), 3) AS mean, round(median(seconds), 3) AS median, round(min(seconds), 3) AS shortest, round(max(seconds), 3) AS longest, count(*) FILTER (WHERE seconds < 3600) AS short FROM items i JOIN sections s ON i.rec_id = s.rec_id AND i.t >= start AND (stop IS NULL OR i.t < stop) GROUP BY ALL", "e", "items", "sections"))
def c29(s, d):
    return J.section_rollup(items(s, d), sections(s, d), BY, "section")


@query("c30_words_in_segment", sql("+w AS (SELECT doc, pos, start AS w_in, start + duration AS w_out FROM segments), g AS (SELECT doc, unnest([20, 60]) AS s_in, unnest([60, 110]) AS s_out FROM segments GROUP BY doc) SELECT w.doc, pos, s_in, CASE WHEN w_in < s_in THEN 'opens' WHEN w_out > s_out THEN 'closes' END AS clipped FROM w JOIN g ON w.doc = g.doc AND w_in < s_out AND s_in < w_out", "segments"))
def c30(s, d):
    from .registry import segments

    g = segments(s, d)
    cuts = g.select("doc").distinct().withColumn("x", F.explode(F.array(*(F.struct(F.lit(a).alias("s_in"), F.lit(b).alias("s_out")) for a, b in ((20, 60), (60, 110)))))).select("doc", "x.*")
    return J.words_in_segment(g.select("doc", "pos", F.col("start").alias("w_in"), (F.col("start") + F.col("duration")).alias("w_out")), cuts, ["doc"]).select("doc", "pos", "s_in", "clipped")


@query("c31_out_of_reach", sql(f"+{_L}, g AS (SELECT rec_id, t, lead(t) OVER w - t AS gap FROM r WINDOW w AS (PARTITION BY rec_id ORDER BY t)), h AS (SELECT rec_id, t, quantile_cont(gap, 0.5) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS sp FROM g) SELECT event_id, abs(t - (SELECT h.t FROM h WHERE h.rec_id = l.rec_id ORDER BY abs(h.t - l.t), h.t LIMIT 1)) > (SELECT h.sp FROM h WHERE h.rec_id = l.rec_id ORDER BY abs(h.t - l.t), h.t LIMIT 1) AS stranded FROM l", "e"))
def c31(s, d):
    return J.out_of_reach(_err(s, d), _views(s, d), BY).select("event_id", "stranded")


@query("c28_projection_shift", """
WITH v AS (SELECT vec_id, embedding[1:16] AS b, lag(embedding[1:16]) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings),
m AS (SELECT vec_id, list_transform(a, lambda x: x::DOUBLE - list_avg(list_transform(a, lambda y: y::DOUBLE))) AS a, list_transform(b, lambda x: x::DOUBLE - list_avg(list_transform(b, lambda y: y::DOUBLE))) AS b FROM v WHERE a IS NOT NULL),
k AS (SELECT vec_id, k, a[1 + greatest(-k, 0) : 16 - greatest(k, 0)] AS x, b[1 + greatest(k, 0) : 16 - greatest(-k, 0)] AS y FROM m, (SELECT unnest(range(-4, 5)) AS k))
SELECT vec_id, arg_max(k, (list_inner_product(x, y) / (sqrt(list_inner_product(x, x) * list_inner_product(y, y)) + 1e-9), -k))::INT AS shift FROM k GROUP BY vec_id
""")
def c28_short(s, d):
    v = read(s, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 16).alias("b"))
    v = v.withColumn("a", F.lag("b").over(Window.partitionBy("label").orderBy("vec_id")))
    return v.where("a is not null").select("vec_id", S.projection_shift("a", "b", 4).alias("shift"))


_CENTRED = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE - list_avg(list_transform(embedding, lambda y: y::DOUBLE))) AS v FROM embeddings), p AS (SELECT a.vec_id, a.label, b.vec_id AS pick, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 5) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), t AS (SELECT vec_id, any_value(label) AS label, arg_max(pick, (score, -pick)) AS pick, max(score) AS score, round(max(score) - min(score), 5) AS margin FROM p GROUP BY vec_id)"


@query("c32_pick_share", f"{_CENTRED} SELECT label, pick, sum(1 + vec_id % 7)::DOUBLE AS seconds, round(sum(1 + vec_id % 7) / sum(sum(1 + vec_id % 7)) OVER (PARTITION BY label), 4) AS share FROM t GROUP BY label, pick")
def c32_share(s, d):
    v = read(s, d, "embeddings")
    picks = c32(s, d).join(v.select("vec_id", "label"), "vec_id").withColumn("seconds", (1 + F.col("vec_id") % 7).cast("double"))
    return S.share_per_pick(picks, ["label"], "pick", "seconds")


@query("c32_nearest_vector", f"{_CENTRED} SELECT vec_id, pick, score, margin FROM t")
def c32(s, d):
    v = read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return J.nearest_vector(v.where("vec_id % 100 = 0"), v, [], "vec_id")


@query("c33_reconcile", sql("+a AS (SELECT doc, start, min(source) AS source FROM segments WHERE flag <> 'R' GROUP BY ALL), b AS (SELECT doc, start, min(part % 100) AS source FROM segments WHERE flag <> 'A' GROUP BY ALL) SELECT a.doc, a.start, CASE WHEN b.doc IS NULL THEN 'misplaced' WHEN b.source <> a.source THEN 'source differs' ELSE 'ok' END AS status FROM a LEFT JOIN b ON a.doc = b.doc AND a.start = b.start", "segments"))
def c33(s, d):
    from .registry import segments

    g = segments(s, d)
    a = g.where("flag <> 'R'").groupBy("doc", "start").agg(F.min("source").alias("source"))
    b = g.where("flag <> 'A'").groupBy("doc", "start").agg(F.min(F.col("part") % 100).alias("source"))
    return J.reconcile(a, b, ["doc", "start"]).select("doc", "start", "status")
