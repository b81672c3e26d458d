"""Further islands, analyses and user functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import aggregates as A
from ..operators import islands as I
from ..operators import joins as J
from ..operators import udf as U
from ..operators import windows as W
from ..sources import catalog as K
from .registry import items, of_type, query, recordings, sql

BY = ["rec_id"]


@query("f12_quiet_passages", sql("+r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY value, t) - 1 AS k, count(*) OVER (PARTITION BY rec_id) AS n, coalesce(lead(t) OVER w, 2 * t - lag(t) OVER w, t) AS t1 FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY t)), y AS (SELECT *, k < n // 3 AS q, ((k < n // 3) AND NOT coalesce(lag(k < n // 3) OVER w, FALSE))::INT AS nw FROM r WINDOW w AS (PARTITION BY rec_id ORDER BY t)), x AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY t) AS i FROM y) SELECT rec_id, min(t) AS start, max(t1) AS stop, count(*) AS rows, max(value) AS peak FROM x WHERE q GROUP BY rec_id, i HAVING max(t1) - min(t) >= 36000", "e"))
def f12(s, d):
    t = W.terciles(recordings(s, d), BY, "value")
    return I.min_length(I.runs(t, BY, F.col("tercile") == "quiet", "value"), 36000.0)


@query("f13_busy_runs", sql("+ix AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS n FROM e), g AS (SELECT *, coalesce(n - lag(n) OVER w > 2, TRUE)::INT AS nw FROM ix WHERE value > 30 WINDOW w AS (PARTITION BY rec_id ORDER BY n)), h AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY n) AS i FROM g), r AS (SELECT rec_id, max(n) + 1 - min(n) AS len FROM h GROUP BY rec_id, i) SELECT rec_id, count(*) FILTER (WHERE len <= 8) AS kept, count(*) FILTER (WHERE len > 8) AS dropped FROM r GROUP BY 1", "e"))
def f13(s, d):
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("t")).cast("long")
    r = I.index_runs(recordings(s, d).withColumn("n", n), BY, "n", F.col("value") > 30, 1)
    length = F.col("end") - F.col("first")
    return r.groupBy("rec_id").agg(F.count_if(length <= 8).alias("kept"), F.count_if(length > 8).alias("dropped"))


@query("e42_salience", sql("+p AS (SELECT rec_id, event_id, t FROM e WHERE event_type = 'view'), m AS (SELECT p.rec_id, p.event_id, coalesce(sqrt(avg(e.value * e.value)), 0) AS r FROM p LEFT JOIN e ON e.rec_id = p.rec_id AND e.t >= p.t AND e.t < p.t + 43200 GROUP BY ALL) SELECT event_id, round(coalesce(r / nullif(max(r) OVER (PARTITION BY rec_id), 0), 0), 5) AS salience FROM m", "e"))
def e42(s, d):
    p = of_type(s, d, "view").select("rec_id", "event_id", F.col("t").alias("start"), (F.col("t") + 43200).alias("stop"))
    r = J.range_agg(p, recordings(s, d).select("rec_id", "t", "value"), BY, "event_id", 43200.0, [F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("r")])
    top = F.nullif(F.max(F.coalesce("r", F.lit(0.0))).over(Window.partitionBy("rec_id")), F.lit(0.0))
    return r.select("event_id", F.round(F.coalesce(F.col("r") / top, F.lit(0.0)), 5).alias("salience"))


@query("e43_hopping_median", sql("SELECT rec_id, w * 43200.0::DOUBLE + 43200 AS t, round(median(value), 5) AS v FROM (SELECT *, unnest(range(floor(t / 43200)::BIGINT - 1, floor(t / 43200)::BIGINT + 1)) AS w FROM e) GROUP BY rec_id, w", "e"))
def e43(s, d):
    return W.windows_around(recordings(s, d), BY, 86400.0, 43200.0).groupBy("rec_id", "start").agg(F.round(F.median("value"), 5).alias("v")).select("rec_id", (F.col("start") + 43200).alias("t"), "v")


@query("i18_supers_review", sql("+sp AS (SELECT rec_id, t AS start, t_end AS stop, event_id AS span, CASE WHEN clip = 'view' THEN 'card' ELSE 'overlay' END AS kind FROM items WHERE value > 60), l AS (SELECT rec_id, t FROM e WHERE event_type = 'error') SELECT kind, count(*) AS spans, round(avg(stop - start), 3) AS held, round(avg((SELECT min(l.t) FROM l WHERE l.rec_id = sp.rec_id AND l.t > stop) - stop), 3) AS clearance FROM sp GROUP BY kind", "e", "items"))
def i18(s, d):
    sp = items(s, d).where("value > 60").select("rec_id", F.col("t").alias("start"), F.col("t_end").alias("stop"), F.when(F.col("clip") == "view", "card").otherwise("overlay").alias("kind"))
    c = J.clearance(sp, of_type(s, d, "error").select("rec_id", "t"), BY)
    return c.groupBy("kind").agg(F.count("*").alias("spans"), F.round(F.avg(F.col("stop") - F.col("start")), 3).alias("held"), F.round(F.avg("clearance"), 3).alias("clearance"))


@query("i21_marker_listing", sql("SELECT rec_id, event_type, list(event_id ORDER BY event_id) AS frames FROM e WHERE t >= 1704153600 AND t < 1704240000 AND event_type <> 'click' GROUP BY ALL", "e"))
def i21(s, d):
    m = K.span_filter(recordings(s, d), 1704153600.0, 1704240000.0).where("event_type <> 'click'")
    return A.markers_by_name(m, BY, "event_type", "event_id")


@query("l01_apply_detector", sql("SELECT event_id, value > 50 AS loud FROM e", "e"))
def l01(s, d):
    return U.apply_detector(recordings(s, d), lambda p: p.assign(loud=p["value"] > 50)[["event_id", "loud"]], "event_id long, loud boolean")


@query("l02_apply_per_key", sql("SELECT rec_id, round(max(c), 4) AS best FROM (SELECT rec_id, sum(value - 20) OVER (PARTITION BY rec_id ORDER BY t) AS c FROM e) GROUP BY 1", "e"))
def l02(s, d):
    import pandas as pd

    fold = lambda g: pd.DataFrame({"rec_id": [g["rec_id"].iloc[0]], "best": [round((g["value"] - 20).cumsum().max(), 4)]})
    return U.apply_per_key(recordings(s, d), BY, fold, "rec_id long, best double")


@query("l03_register_aggregate", sql("SELECT rec_id, round(max(value) - min(value), 6) AS span FROM e GROUP BY 1", "e"))
def l03(s, d):
    return recordings(s, d).groupBy("rec_id").agg(F.round(U.register_aggregate(lambda v: float(v.max() - v.min()))("value"), 6).alias("span"))


@query("l04_explode_rows", sql("SELECT event_id, unnest(range(event_id % 3)) AS k FROM e", "e"))
def l04(s, d):
    e = recordings(s, d).select("event_id", (F.col("event_id") % 3).alias("n"))
    return U.explode_rows(e, lambda n: ((k,) for k in range(n)), ["n"], "k long").select("event_id", "k")


@query("l03_mergeable_aggregate", sql("SELECT rec_id, count(*) AS n, round(avg(value), 9) AS mean, round(var_pop(value), 4) AS spread, arg_min(event_id, (value, event_id)) AS lowest FROM e GROUP BY 1", "e"))
def l03_merged(s, d):
    """Count, mean and variance by merging moments, and the id of the lowest value."""

    def update(state, rows):
        v = rows["value"]
        low = min(zip(v, rows["event_id"], strict=True))
        return merge(state, (len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum()), low))

    def merge(a, b):
        if a is None:
            return b
        n, off = a[0] + b[0], b[1] - a[1]
        return n, a[1] + off * b[0] / n, a[2] + b[2] + off * off * a[0] * b[0] / n, min(a[3], b[3])

    finish = lambda x: (x[0], round(x[1], 9), round(x[2] / x[0], 4), int(x[3][1]))
    return U.mergeable_aggregate(recordings(s, d), BY, ["value", "event_id"], lambda: None, update, merge, finish, "n long, mean double, spread double, lowest long")


class _Steps:
    """The row at which a running sum of values passes each hundred."""

    def __init__(self):
        self.total, self.passed = 0.0, 0

    def feed(self, row):
        self.total += row["value"]
        while round(self.total, 6) >= 100 * (self.passed + 1):
            self.passed += 1
            yield row["rec_id"], self.passed, row["event_id"]

    def end(self):
        return ()


@query("l04_rows_in_order", sql("SELECT rec_id, k AS step, event_id FROM (SELECT rec_id, event_id, floor(c / 100)::INT AS hi, floor(coalesce(lag(c) OVER (PARTITION BY rec_id ORDER BY t), 0) / 100)::INT AS lo FROM (SELECT *, round(sum(value) OVER (PARTITION BY rec_id ORDER BY t), 6) AS c FROM e)), (SELECT unnest(range(1, 1000)) AS k) WHERE k > lo AND k <= hi", "e"))
def l04_ordered(s, d):
    e = recordings(s, d).select("rec_id", "t", "event_id", "value")
    return U.rows_in_order(e, BY, ["t"], _Steps, lambda of: StructType([of["rec_id"], StructField("step", IntegerType()), of["event_id"]]))
