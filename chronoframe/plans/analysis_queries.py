"""Queries over the further analyses, and over the islands that need folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import islands as I
from . import analyses as N
from .registry import items, levels, of_type, query, read, recordings, sql

BY = ["rec_id"]


def _layers(s, d):
    return recordings(s, d).select("rec_id", "event_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 1500).alias("stop"), (F.col("event_id") % 3 != 0).alias("media"))


@query(
    "f17_drop_covered",
    sql(
        """+i AS (SELECT rec_id, event_id, t AS start, t + value * 1500 AS stop, event_id % 3 <> 0 AS media FROM e),
        p AS (SELECT a.rec_id, a.event_id, a.start AS at FROM i a WHERE NOT media UNION ALL SELECT a.rec_id, a.event_id, b.stop FROM i a JOIN i b ON a.rec_id = b.rec_id AND a.event_id <> b.event_id AND b.stop > a.start AND b.stop < a.stop WHERE NOT a.media),
        bare AS (SELECT DISTINCT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.rec_id = p.rec_id AND b.event_id <> p.event_id AND b.start <= p.at AND p.at < b.stop)),
        o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start, NOT media, event_id, stop) AS n FROM i WHERE media OR event_id IN (SELECT event_id FROM bare)),
        f AS (SELECT rec_id, n, event_id, start, stop, TRUE AS kept FROM o WHERE n = 1 UNION ALL
              SELECT o.rec_id, o.n, o.event_id, CASE WHEN o.start >= f.stop OR f.start >= o.stop THEN o.start ELSE f.start END, CASE WHEN o.start >= f.stop OR f.start >= o.stop THEN o.stop ELSE f.stop END, o.start >= f.stop OR f.start >= o.stop
              FROM f JOIN o ON o.rec_id = f.rec_id AND o.n = f.n + 1)
        SELECT rec_id, event_id FROM f WHERE kept""",
        "e",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def f17(s, d):
    return I.drop_covered(_layers(s, d), BY, "event_id", chunk=604800.0).select("rec_id", "event_id")


@query(
    "f18_merge_same_kind",
    sql(
        """+i AS (SELECT rec_id, t AS start, t + value * 900 AS stop, event_type AS kind FROM e), k AS (SELECT *, (coalesce(lag(kind) OVER w = kind, FALSE)) AS same FROM i WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop, kind)),
        r AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY rec_id ORDER BY start, stop, kind ROWS UNBOUNDED PRECEDING) AS k FROM k),
        g AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY rec_id, k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600, TRUE)::INT AS nw FROM r),
        h AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id, k ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM g)
        SELECT rec_id, kind, min(start) AS start, max(stop) AS stop, count(*) AS spans FROM h GROUP BY rec_id, kind, k, g""",
        "e",
    ),
)
def f18(s, d):
    return I.merge_same_kind(recordings(s, d).select("rec_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 900).alias("stop"), F.col("event_type").alias("kind")), BY, 3600.0)


@query("f18_span_groups")
def f18_groups(s, d):
    r = recordings(s, d).select("rec_id", F.col("t").alias("start"), (F.col("t") + 600).alias("stop"), F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")), lambda k: F.pmod(F.col("event_id") * (k + 7), F.lit(5)) > 1), lambda k: k).alias("mask"))
    return I.span_groups(r, BY, "rec_id long", 86400.0, 4)


@query("f19_note_spans")
def f19(s, d):
    f = recordings(s, d).select("rec_id", (F.col("t") / 100_000).alias("t"), F.col("value").alias("level"), F.when(F.col("event_type") == "error", 0.0).otherwise(100 + F.floor(F.col("event_id") / 4) % 3 * 20).cast("double").alias("hz"))
    return I.note_spans(f, BY, "rec_id long").drop("run")


def _beats(s, d):
    """The events as beats, a hundred thousand times as fast; recordings with an even id have bars of three."""
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("t")).cast("long")
    t = F.col("t") / F.when(F.col("rec_id") % 3 == 0, 400_000).otherwise(40_000)
    return recordings(s, d).select("rec_id", t.alias("t"), n.alias("beat"), F.when(F.col("rec_id") % 2 == 0, F.floor((n - 1) / 3) + 1).otherwise(n).alias("bar"), "value", "event_id")


def _salient(s, d):
    accent = F.when(F.col("beat") % F.when(F.col("rec_id") % 3 == 0, 4).otherwise(3) == 1, F.col("value") + 60).otherwise(F.col("value") / 4)
    return _beats(s, d).withColumn("salience", F.when(F.col("rec_id") % 5 == 0, F.col("value")).otherwise(accent))


@query("i02_bar_map")
def i02(s, d):
    return N.bar_map(_salient(s, d), BY)[0]


@query("i02_bars")
def i02_bars(s, d):
    return N.bar_map(_salient(s, d), BY)[1]


def _numbered_grid(s, d):
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("t")).cast("long")
    return of_type(s, d, "view").select("rec_id", "t", n.alias("beat"), (F.floor((n - 1) / 4) + 1).alias("bar"), (n % 4 == 1).alias("downbeat"))


@query("i06_bursts_over_baseline")
def i06(s, d):
    return N.bursts_over_baseline(recordings(s, d).where("event_type <> 'view'"), _numbered_grid(s, d), BY, "event_type", "click", "error", half=8, skip=2, least=0.2)


@query("i07_phrase_boundaries")
def i07(s, d):
    notes = recordings(s, d).select("rec_id", "t", (F.col("t") + F.col("value") * 600).alias("end"), (80 + F.col("event_id") % 7 * 40).cast("double").alias("hz"))
    return N.phrase_boundaries(notes, _numbered_grid(s, d), BY)


@query(
    "i12_quiet_floor",
    sql(
        """+s AS (SELECT rec_id, t, median(level) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM level),
        q AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS n, row_number() OVER (PARTITION BY rec_id ORDER BY v, t) - 1 < count(*) OVER (PARTITION BY rec_id) // 3 AS quiet FROM s),
        r AS (SELECT *, coalesce(n - lag(n) OVER (PARTITION BY rec_id ORDER BY n) > 1, TRUE)::INT AS nw FROM q WHERE quiet), i AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY n) AS i FROM r),
        p AS (SELECT rec_id, min(t) AS start, max(t) + 3600 AS stop FROM i GROUP BY rec_id, i HAVING max(t) + 3600 - min(t) >= 72000),
        h AS (SELECT p.rec_id, p.start, x.t, x.seconds FROM p JOIN items x ON x.rec_id = p.rec_id AND x.t >= p.start AND x.t < p.stop),
        m AS (SELECT *, median(seconds) OVER (PARTITION BY rec_id, start) AS m, lag(seconds) OVER w AS a, lead(seconds) OVER w AS b FROM h WINDOW w AS (PARTITION BY rec_id, start ORDER BY t)),
        o AS (SELECT *, coalesce(seconds < m / 2 AND a >= m AND b >= m, FALSE) AS orphan FROM m),
        c AS (SELECT rec_id, start, count(*) AS items, round(median(seconds), 3) AS median, CASE WHEN count(*) > 1 THEN round(stddev_pop(seconds) / avg(seconds), 4) END AS cv, count(*) FILTER (WHERE orphan) AS orphans,
              CASE WHEN count(*) FILTER (WHERE NOT orphan) > 1 THEN round(stddev_pop(seconds) FILTER (WHERE NOT orphan) / avg(seconds) FILTER (WHERE NOT orphan), 4) END AS cv_less_orphans FROM o GROUP BY ALL),
        z AS (SELECT p.*, coalesce(c.items, 0) AS items, c.median, c.cv, coalesce(c.orphans, 0) AS orphans, c.cv_less_orphans,
              CASE WHEN c.items IS NULL THEN (SELECT max(seconds) FROM items x WHERE x.rec_id = p.rec_id AND x.t <= p.start AND x.t + x.seconds >= p.stop) END AS held_through FROM p LEFT JOIN c ON c.rec_id = p.rec_id AND c.start = p.start)
        SELECT rec_id, start, stop, items, round(60 * items / (stop - start), 4) AS rate, median, cv, orphans, cv_less_orphans, held_through, held_through IS NOT NULL OR coalesce(cv_less_orphans < 0.65, FALSE) AS locked FROM z""",
        "e",
        "items",
        "level",
    ),
)
def i12(s, d):
    return N.quiet_floor(items(s, d), levels(s, d), BY, 3600.0, 72_000.0)


@query(
    "i15_readback",
    """WITH w AS (SELECT conv_id * 100 + turn AS source, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS k FROM conversations WHERE turn % 3 <> 2),
    x AS (SELECT source, 10 * k AS w_in, 10 * k + 8 AS w_out, word, length(word) % 10 / 10.0 AS confidence FROM w),
    g AS (SELECT conv_id AS doc, turn AS pos, conv_id * 100 + turn // 2 * 2 AS source, 15 + turn % 2 * 20 AS s_in, 75 + turn % 4 * 17 AS s_out FROM conversations),
    l AS (SELECT *, sum(s_out - s_in) OVER (PARTITION BY doc ORDER BY pos) - (s_out - s_in) AS start, coalesce(lag(source) OVER (PARTITION BY doc ORDER BY pos) = source, FALSE) AS jump FROM g),
    m AS (SELECT l.doc, l.pos, x.*, w_in >= s_in AND w_out <= s_out AS inside FROM l JOIN x ON x.source = l.source AND w_in < s_out AND s_in < w_out),
    c AS (SELECT doc, pos, coalesce(list(word ORDER BY w_in) FILTER (WHERE inside), []) AS said, count(*) FILTER (WHERE inside AND confidence < 0.4) AS unsure, count(*) FILTER (WHERE NOT inside) AS clipped FROM m GROUP BY ALL),
    r AS (SELECT l.*, coalesce(said, []) AS said, coalesce(unsure, 0) AS unsure, coalesce(clipped, 0) AS clipped, EXISTS (SELECT 1 FROM x WHERE x.source = l.source) AS known FROM l LEFT JOIN c USING (doc, pos)),
    q AS (SELECT *, lag(said) OVER (PARTITION BY doc ORDER BY pos) AS p FROM r)
    SELECT doc, pos, source, start::BIGINT AS start, CASE WHEN known THEN len(said) END AS words, array_to_string(said, ' ') AS text, CASE WHEN known THEN unsure END AS unsure, CASE WHEN known THEN clipped END AS clipped,
           coalesce((SELECT max(n) FROM unnest(range(1, least(len(p), len(said)) + 1)) u(n) WHERE p[len(p) - n + 1:] = said[:n]), 0) AS repeated, jump FROM q""",
)
def i15(s, d):
    c = read(s, d, "conversations")
    words = c.where("turn % 3 <> 2").select((F.col("conv_id") * 100 + F.col("turn")).alias("source"), F.posexplode(F.split("text", " ")).alias("k", "word"))
    words = words.select("source", (10 * (F.col("k") + 1)).cast("long").alias("w_in"), (10 * (F.col("k") + 1) + 8).cast("long").alias("w_out"), "word", (F.char_length("word") % 10 / 10).alias("confidence"))
    t = F.col("turn")
    cuts = c.select(F.col("conv_id").alias("doc"), t.alias("pos"), (F.col("conv_id") * 100 + F.floor(t / 2) * 2).alias("source"), (15 + t % 2 * 20).alias("s_in"), (75 + t % 4 * 17).alias("s_out"))
    return N.readback(cuts, words, ["doc"], 0.4)


@query(
    "i16_classify_windows",
    sql(
        """+n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS n, quantile_cont(value, 0.2) OVER (PARTITION BY rec_id) AS band, min(value) OVER (PARTITION BY rec_id) AS low FROM e),
        h AS (SELECT *, coalesce(n - lag(n) OVER (PARTITION BY rec_id ORDER BY n) > 2, TRUE)::INT AS nw FROM n WHERE value > 30), g AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY n) AS g FROM h),
        s AS (SELECT rec_id, min(n) AS a, max(n) AS b FROM g GROUP BY rec_id, g HAVING max((value > 60)::INT) = 1),
        l AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.rec_id = n.rec_id AND n.n BETWEEN a AND b) THEN 'noisy' WHEN low <= band - 1 AND value <= least(low + 1, band - 0.5) THEN 'silence' ELSE 'music' END AS label FROM n),
        m AS (SELECT *, lag(label) OVER w AS p, lead(label) OVER w AS q FROM l WINDOW w AS (PARTITION BY rec_id ORDER BY t))
        SELECT rec_id, t, CASE WHEN p = q AND label <> p AND label <> 'noisy' THEN p ELSE label END AS label FROM m""",
        "e",
    ),
)
def i16(s, d):
    return N.classify_windows(recordings(s, d), BY, "value", F.col("value") > 60, F.col("value") > 30, 1, gap=1.0, margin=1.0, headroom=0.5)
