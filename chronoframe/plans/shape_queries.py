"""Queries over vectors and shapes of curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import shapes as S
from ..operators import vectors as V
from ..operators import windows as W
from .registry import CTES, query, read, recordings, sql

BY, OF = ["rec_id"], ["label"]

#: Pictures of eight by eight, 0 to 1, numbered within their label.
CTES["pic"] = "pic AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, list_transform(embedding, lambda x: x::DOUBLE + 0.5) AS vec FROM embeddings)"
CTES["px"] = "px AS (SELECT label, vec_id, pos, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS e FROM pic)"


def pictures(spark, d) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    return read(spark, d, "embeddings").select("label", "vec_id", pos.alias("pos"), F.transform("embedding", lambda x: x.cast("double") + 0.5).alias("vec"))


@query("e32_vector_step")
def e32(s, d):
    return V.vector_step(pictures(s, d), OF, "vec", "pos", 8).drop("vec", "pos")


@query(
    "e39_step_median_stack",
    sql(
        """+w AS (SELECT label, pos AS cut, side, pos + k AS p FROM pic, (VALUES ('out', -4), ('out', -3), ('out', -2), ('in', 1), ('in', 2), ('in', 3)) o(side, k) WHERE pos % 5 = 0),
        m AS (SELECT w.label, cut, side, e, median(x) AS m FROM w JOIN px ON px.label = w.label AND px.pos = w.p GROUP BY ALL HAVING count(*) = 3)
        SELECT label, cut, side, round(sum(m), 6) AS total, round(max(m), 6) AS most, round(sum(m * e), 6) AS moment FROM m GROUP BY ALL""",
        "pic",
        "px",
    ),
)
def e39(s, d):
    v = pictures(s, d)
    st = V.step_median_stack(v, v.where("pos % 5 = 0").select("label", F.col("pos").alias("cut")), OF, "vec", "pos", "cut")
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), 6)
    return st.select("label", "cut", "side", total(F.col("stack")).alias("total"), F.round(F.array_max("stack"), 6).alias("most"), total(F.transform("stack", lambda x, i: x * i)).alias("moment"))


_LOST = """+c AS (SELECT *, x <= 0.4 AS b FROM px), r AS (SELECT label, e, avg(b::INT) AS occ, quantile_cont(x, 0.5) AS ref FROM c GROUP BY ALL),
        l AS (SELECT label, pos, round(count(*) FILTER (WHERE b) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE b AND occ < 0.25) / count(*), 6) AS novel,
              round(count(*) FILTER (WHERE b AND ref - x > 0.05) / count(*), 6) AS hidden FROM c JOIN r USING (label, e) GROUP BY ALL)"""


@query("e40_lost_picture", sql(_LOST + " SELECT * FROM l", "pic", "px"))
def e40(s, d):
    return V.lost_picture(pictures(s, d), OF, "vec", "pos", 0.4)


@query(
    "i14_obstruction_catalog",
    sql(
        _LOST
        + """, q AS (SELECT *, quantile_cont(coverage, 0.2) OVER (PARTITION BY label) AS base, coverage - lag(coverage) OVER (PARTITION BY label ORDER BY pos) AS rise FROM l),
        g AS (SELECT *, least(greatest((coverage - base) / 0.3, 0), 1) + least(greatest(coalesce(rise, 0), 0), 0.15) AS score FROM q),
        f AS (SELECT *, coalesce(pos - lag(pos) OVER w > 2, TRUE)::INT AS nw FROM g WHERE score >= 0.35 WINDOW w AS (PARTITION BY label ORDER BY pos)),
        i AS (SELECT *, sum(nw) OVER (PARTITION BY label ORDER BY pos) AS i FROM f)
        SELECT label, min(pos) AS first, max(pos) + 1 AS stop, count(*) AS k, round(max(score), 6) AS peak_score, round(max(novel), 6) AS peak_novel, round(max(hidden), 6) AS peak_hidden,
               CASE WHEN max(novel) >= 0.035 OR max(hidden) >= 0.22 THEN 'obstruction' ELSE 'scene' END AS kind FROM i GROUP BY label, i""",
        "pic",
        "px",
    ),
)
def i14(s, d):
    lost = V.lost_picture(pictures(s, d), OF, "vec", "pos", 0.4).withColumn("t", F.col("pos"))
    found = V.obstruction_catalog(W.rise_bonus(lost, OF, "coverage"), OF, "pos", 0.35, hidden=0.22)
    return found.withColumnsRenamed({"end": "stop", "n": "k"})


@query("f21_ghost_events")
def f21(s, d):
    """Every third picture is replaced by the mean of its neighbours two away, as a blend would show."""
    w = Window.partitionBy("label").orderBy("pos")
    mean = F.zip_with(F.lag("vec", 2).over(w), F.lead("vec", 2).over(w), lambda a, b: (a + b) / 2)
    v = pictures(s, d).withColumn("vec", F.when(F.col("pos") % 3 == 0, F.coalesce(mean, F.col("vec"))).otherwise(F.col("vec")))
    return V.ghost_events(v, OF, "vec", "pos", 2, 0.05, 2, residual=0.6).withColumnsRenamed({"end": "stop", "n": "k"})


@query(
    "f22_edges_of_presence",
    sql(
        """+a AS (SELECT p.label, p.pos AS anchor, list_transform([1, 9, 17, 25], lambda i: p.vec[i + 1]) AS held FROM pic p WHERE p.pos = 10),
        f AS (SELECT p.label, p.pos, anchor, list_avg(list_transform([1, 2, 3, 4], lambda k: (abs(p.vec[8 * k - 6] - held[k]) <= 0.2)::INT)) >= 0.5 AS same,
              (p.vec[2] + p.vec[10] + p.vec[18] + p.vec[26]) / 4 - list_avg(p.vec) >= 0 AS drawn FROM pic p JOIN a ON a.label = p.label),
        b AS (SELECT label, anchor, min(pos) AS lo, max(pos) AS hi, coalesce(max(pos) FILTER (WHERE pos < anchor AND NOT same) + 1, min(pos)) AS first,
              coalesce(min(pos) FILTER (WHERE pos > anchor AND NOT same) - 1, max(pos)) AS last FROM f GROUP BY ALL)
        SELECT f.label, f.anchor, first, last, first - 1 - coalesce(max(pos) FILTER (WHERE pos < first AND NOT drawn), lo - 1) AS ramp_in,
               coalesce(min(pos) FILTER (WHERE pos > last AND NOT drawn), hi + 1) - last - 1 AS ramp_out FROM f JOIN b USING (label, anchor) GROUP BY f.label, f.anchor, first, last, lo, hi""",
        "pic",
    ),
)
def f22(s, d):
    v = pictures(s, d)
    anchors = v.where("pos = 10").select("label", F.col("pos").alias("anchor"), F.array(*map(F.lit, (1, 9, 17, 25))).alias("mask"))
    return V.edges_of_presence(v, anchors, OF, "vec", "pos", 0.2, 0.5, 0.0)


#: Curves: the values of a recording, hours apart; smoothed so that they move slowly enough to have shapes.
CTES["curve"] = "curve AS (SELECT rec_id, t / 3600 AS t, value, round(avg(value) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS level FROM e)"


def curves(s, d) -> DataFrame:
    smooth = F.round(F.avg("value").over(Window.partitionBy("rec_id").orderBy("t").rowsBetween(-3, 3)), 4)
    return recordings(s, d).select("rec_id", (F.col("t") / 3600).alias("t"), "value", smooth.alias("level"))


@query(
    "e36_descent",
    sql(
        """+n AS (SELECT rec_id, t, level AS v, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY rec_id) AS n FROM curve),
        f AS (SELECT rec_id, arg_max(v, i) AS final, max(v) AS top, any_value(n) AS n FROM n GROUP BY 1),
        b AS (SELECT f.*, coalesce((SELECT max(i) + 1 FROM n WHERE n.rec_id = f.rec_id AND n.v > greatest(0.2, final + 5)), 0) AS bl FROM f),
        d AS (SELECT n.rec_id, n.i, n.v, n.t, b.bl, b.final, b.top, b.n AS cnt, n.i < b.bl AND ((SELECT v FROM n x WHERE x.rec_id = n.rec_id AND x.i = least(n.i + 1, n.n - 1)) - (SELECT v FROM n x WHERE x.rec_id = n.rec_id AND x.i = greatest(n.i - 1, 0))) / ((least(n.i + 1, n.n - 1) - greatest(n.i - 1, 0)) / 4.0) <= -4 AS down FROM n JOIN b USING (rec_id)),
        k AS (SELECT *, i < bl AND coalesce((SELECT min(x.i) FROM d x WHERE x.rec_id = d.rec_id AND x.i > d.i AND x.down), bl) - i > 2 AS broken FROM d),
        o AS (SELECT rec_id, coalesce(max(i) FILTER (WHERE broken), -1) AS stop FROM k GROUP BY 1),
        s AS (SELECT rec_id, any_value(bl) AS bl, any_value(final) AS final, any_value(top) AS top, any_value(cnt) AS cnt, coalesce(min(i) FILTER (WHERE down AND i > stop), any_value(bl)) AS fr FROM k JOIN o USING (rec_id) GROUP BY 1),
        p AS (SELECT s.*, (SELECT max(v) FROM k WHERE k.rec_id = s.rec_id AND k.i BETWEEN greatest(fr - 2, 0) AND fr) AS plateau FROM s),
        r AS (SELECT p.*, coalesce((SELECT max(i) FROM k WHERE k.rec_id = p.rec_id AND k.i BETWEEN fr AND p.bl AND v >= 0.9 * plateau), fr) AS ra FROM p),
        z AS (SELECT r.*, (SELECT t FROM k WHERE k.rec_id = r.rec_id AND k.i = r.bl) AS tb, (SELECT t FROM k WHERE k.rec_id = r.rec_id AND k.i = fr) AS td, (SELECT t FROM k WHERE k.rec_id = r.rec_id AND k.i = ra) AS tr,
              coalesce((SELECT avg((v <= pv)::INT) FROM (SELECT i, v, lag(v) OVER (ORDER BY i) AS pv FROM k WHERE k.rec_id = r.rec_id) WHERE i > ra AND i <= r.bl), 1) AS share FROM r),
        y AS (SELECT *, CASE WHEN cnt < 3 THEN 'unknown' WHEN final > 25 THEN 'ends_lit' WHEN bl = 0 OR top <= 25 THEN 'black_window' WHEN tb - tr < 10 THEN 'hard_to_black' WHEN tb - tr <= 100 AND share >= 0.7 THEN 'dissolve_to_black' ELSE 'dim_to_black' END AS kind FROM z)
        SELECT rec_id, kind, CASE WHEN kind NOT IN ('unknown', 'ends_lit') THEN round(tb, 3) END AS black_at, CASE WHEN kind LIKE '%_to_black' THEN round(td, 3) END AS descent_at, CASE WHEN kind LIKE '%_to_black' THEN round(plateau, 2) END AS plateau,
               CASE WHEN kind LIKE '%_to_black' THEN round(tr, 3) END AS ramp_at, CASE WHEN kind LIKE '%_to_black' THEN round(share, 3) END AS monotone_share FROM y""",
        "e",
        "curve",
    ),
)
def e36(s, d):
    return S.descent(curves(s, d), BY, "level", 4.0, dark=25.0, margin=5.0, slope=4.0, pause=0.5, least=10.0, most=100.0)


@query(
    "e37_head_and_tail",
    sql(
        """+n AS (SELECT rec_id, t, level AS v, row_number() OVER w - 1 AS i, lag(level) OVER w AS pv, min(t) OVER k AS t0, max(t) OVER k AS t1 FROM curve WINDOW w AS (PARTITION BY rec_id ORDER BY t), k AS (PARTITION BY rec_id)),
        g AS (SELECT rec_id, max(v) FILTER (WHERE t <= t0 + 48) AS peak, quantile_cont(v, 0.5) FILTER (WHERE t <= t1 - 72) AS body, max(v) FILTER (WHERE i = 1) AS v1, max(i) FILTER (WHERE v > 20) AS lit, count(*) AS n FROM n GROUP BY 1),
        o AS (SELECT g.rec_id, coalesce(min(i) FILTER (WHERE i >= 1 AND abs(v - v1) > 9), any_value(g.n)) AS off FROM n JOIN g USING (rec_id) GROUP BY 1)
        SELECT n.rec_id, min(t) FILTER (WHERE t <= t0 + 48 AND v >= 0.98 * peak) AS reaches, max(t) FILTER (WHERE i >= 1 AND i < off) - min(t) FILTER (WHERE i = 1) AS plateau, round(any_value(body), 6) AS body,
               max(t) FILTER (WHERE v >= 0.97 * body) AS leaves, min(t) FILTER (WHERE i > coalesce(lit, -1)) AS black_from,
               CASE WHEN min(t) FILTER (WHERE i > coalesce(lit, -1)) IS NULL THEN 'unknown' WHEN max(v) FILTER (WHERE i = lit) > 0.8 * any_value(body) THEN 'hard' ELSE 'dissolve' END AS kind
        FROM n JOIN g USING (rec_id) JOIN o USING (rec_id) GROUP BY n.rec_id""",
        "e",
        "curve",
    ),
)
def e37(s, d):
    return S.head_and_tail(curves(s, d), BY, "level", 48.0, 72.0, 20.0, hold=9.0)


@query("e38_transition_kind")
def e38(s, d):
    """Windows of nine pictures; in every other one the middle five lead from the second to the eighth by even steps, or down to 0."""
    v = pictures(s, d).withColumn("window", F.floor((F.col("pos") - 1) / 9)).withColumn("k", (F.col("pos") - 1) % 9)
    key = Window.partitionBy("label", "window")
    v = v.withColumns({"a": F.max(F.when(F.col("k") == 1, F.col("vec"))).over(key), "b": F.max(F.when(F.col("k") == 7, F.col("vec"))).over(key), "inner": F.col("k").between(2, 6)})
    blend = F.zip_with("a", "b", lambda x, y: x + (y - x) * (F.col("k") - 1) / 6)
    dim = F.transform("vec", lambda x: x * F.greatest(6 - F.col("k"), F.lit(0)) / 6)
    kind = (F.col("window") + F.col("label")) % 3
    vec = F.when((kind == 0) & F.col("inner"), blend).when(kind == 1, dim).otherwise(F.col("vec"))
    return S.transition_kind(v.select("label", "window", F.col("pos").alias("t"), vec.alias("vec")), ["label", "window"], "vec", 0.02, 0.1, 0.3).withColumnRenamed("peak", "largest")


@query(
    "e44_tail_checks",
    sql(
        """+b AS (SELECT rec_id, t, level, -level AS other, min(t) OVER k + 0.5 * (max(t) OVER k - min(t) OVER k) AS a, max(t) OVER k AS z FROM curve WINDOW k AS (PARTITION BY rec_id)),
        r AS (SELECT *, CASE WHEN t >= a THEN level / greatest(avg(level) FILTER (WHERE t < a) OVER (PARTITION BY rec_id), 1e-9) END AS r FROM b),
        q AS (SELECT *, r - lag(r) OVER (PARTITION BY rec_id ORDER BY t) AS rise, CASE WHEN r > 0.08 AND r < 0.92 THEN t END AS mid FROM r),
        m AS (SELECT rec_id, floor(t / 48) AS w, round(avg(other), 6) AS m FROM b WHERE t >= a GROUP BY ALL), u AS (SELECT *, m >= lag(m) OVER (PARTITION BY rec_id ORDER BY w) AS up FROM m),
        f AS (SELECT rec_id, count(*) > 2 AND NOT coalesce(bool_or(up), FALSE) AS fades FROM u GROUP BY 1),
        c AS (SELECT rec_id, count(mid) >= 5 AS ramps, coalesce(max(mid) - min(mid) > 0.7 * (max(z) - max(a)), FALSE) AS spans, coalesce(max(rise) <= 0.4, TRUE) AS falls, coalesce(arg_max(r, t) FILTER (WHERE r IS NOT NULL) < 0.4, FALSE) AS lands, coalesce(arg_max(other, t) < -20, FALSE) AS ends_quiet FROM q GROUP BY 1)
        SELECT rec_id, ramps, spans, falls, lands, coalesce(fades, FALSE) AS fades, ends_quiet, ramps AND spans AND falls AND lands AND coalesce(fades, FALSE) AND ends_quiet AS passed FROM c LEFT JOIN f USING (rec_id)""",
        "e",
        "curve",
    ),
)
def e44(s, d):
    key = Window.partitionBy("rec_id")
    c = curves(s, d).select("rec_id", "t", "level", (-F.col("level")).alias("other"), (F.min("t").over(key) + 0.5 * (F.max("t").over(key) - F.min("t").over(key))).alias("a"), F.max("t").over(key).alias("z"))
    return S.tail_checks(c, BY, "level", "other", "a", "z", 48.0, least=5, slack=0.4, quiet=-20.0)
