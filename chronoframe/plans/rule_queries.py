"""Queries over orders and sets (G, H), rules (J), catalogs (A) and user functions (L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import rules as R
from ..sources import catalog as K
from .registry import items, of_type, query, read, recordings, segments, sql

BY = ["rec_id"]


@query("a06_pending", sql("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')"))
def a06(s, d):
    done = read(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_returnflag") == "N").alias("artifacts_exist"))
    return K.pending(read(s, d, "orders").select(F.col("o_orderkey").alias("key")), done)


@query("a07_sequence_run", sql("WITH n AS (SELECT DISTINCT p_brand AS stem, p_size::BIGINT AS k FROM part WHERE p_size % 7 <> 3), r AS (SELECT stem, k, k - row_number() OVER (PARTITION BY stem ORDER BY k) AS i FROM n) SELECT stem, min(k) AS first, count(*) AS length FROM r WHERE i = (SELECT arg_min(q.i, q.k) FROM r q WHERE q.stem = r.stem) GROUP BY stem"))
def a07(s, d):
    files = read(s, d, "part").where("p_size % 7 <> 3").select(F.concat(F.translate("p_brand", "0123456789", "abcdefghij"), F.lit("."), F.format_string("%04d", "p_size"), F.lit(".png")).alias("path"), "p_brand")
    return K.sequence_run(files, by=["p_brand"]).select(F.col("p_brand").alias("stem"), "first", "length")


@query("a09_history", sql("SELECT event_id FROM events WHERE event_type = 'error'"))
def a09(s, d):
    runs = read(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"), F.col("ts").alias("started_at"), F.col("event_id").alias("sequence"))
    return K.history(runs, "failed").select("event_id")


@query("a10_list_inventory", sql("SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND contains(lower(p_name), 'a') AND p_size > 20"))
def a10(s, d):
    inv = read(s, d, "part").select("p_partkey", F.concat(F.lit("Master/"), "p_brand").alias("bin"), F.col("p_name").alias("name"), (F.col("p_size") > 20).alias("offline"))
    return K.list_inventory(inv, "Master/Brand#1", "A", True).select("p_partkey")


@query("a11_inspect_range", sql("SELECT rec_id, clip, count(*) AS items, count(*) FILTER (WHERE t < 1704240000 AND t_end > 1704153600) AS touching FROM items GROUP BY ALL", "e", "items"))
def a11(s, d):
    i = items(s, d).select("rec_id", "clip", F.col("t").alias("first"), F.col("t_end").alias("last"))
    return K.inspect_range(i, ["rec_id", "clip"], 1704153600.0, 1704240000.0)


@query("g01_time_order", sql("SELECT event_id, row_number() OVER (PARTITION BY rec_id ORDER BY floor(t / 3600), event_type <> 'view', event_id) AS pos FROM e", "e"))
def g01(s, d):
    i = recordings(s, d).select("rec_id", "event_id", F.floor(F.col("t") / 3600).alias("start"), (F.col("event_type") == "view").alias("media"))
    return O.time_order(i, ["rec_id"], "start", ~F.col("media"), "event_id").select("event_id", "pos")


@query("g02_worst_n", sql("SELECT event_id, value FROM e ORDER BY value DESC, event_id LIMIT 8", "e"))
def g02(s, d):
    return O.worst_n(recordings(s, d), "value", "event_id").select("event_id", "value")


@query("g03_order_findings", sql("+f AS (SELECT rec_id AS doc, event_id, CASE event_type WHEN 'error' THEN 'E2' WHEN 'view' THEN 'W1' WHEN 'click' THEN 'W12' ELSE 'E10' END AS rule FROM e) SELECT event_id, row_number() OVER (PARTITION BY doc ORDER BY rule LIKE 'E%' DESC, rule[2:]::INT, event_id) AS rank FROM f", "e"))
def g03(s, d):
    t = F.col("event_type")
    f = recordings(s, d).select(F.col("rec_id").alias("doc"), "event_id", F.col("event_id").alias("pos"), F.when(t == "error", "E2").when(t == "view", "W1").when(t == "click", "W12").otherwise("E10").alias("rule"))
    return O.order_findings(f).select("event_id", "rank")


@query("g06_round_robin_cap", sql("+r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, event_type ORDER BY event_id) AS rd FROM e) SELECT event_id FROM r QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY rd, event_type) <= 7", "e"))
def g06(s, d):
    return O.round_robin_cap(recordings(s, d), BY, "event_type", "event_id", 7).select("event_id")


@query("g07_rank_candidates", sql("SELECT event_id, row_number() OVER w AS rank, round(value - lead(value) OVER w, 6) AS margin FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY round(value, 6) DESC, event_id)", "e"))
def g07(s, d):
    return O.rank_candidates(recordings(s, d), BY, "value", ["event_id"]).select("event_id", "rank", "margin")


@query("g08_pick_extremes", sql("SELECT rec_id, arg_max(event_id, (seconds, -event_id)) AS longest, arg_min(event_id, (seconds, event_id)) AS shortest, arg_max(event_id, (CASE WHEN clip = 'view' THEN 'inf'::DOUBLE ELSE value END, -event_id)) AS densest FROM items GROUP BY 1", "e", "items"))
def g08(s, d):
    return O.pick_extremes(items(s, d).withColumn("dens", F.when(F.col("clip") != "view", F.col("value"))), BY, "event_id", "seconds", "dens")


@query("h01_union_events", sql("SELECT rec_id, t, event_id, event_type AS kind FROM e WHERE event_type IN ('view', 'click')", "e"))
def h01(s, d):
    pick = lambda k: of_type(s, d, k).select("rec_id", "t", "event_id")
    return O.union_events(view=pick("view"), click=pick("click"))


@query("h02_merge_signals", sql("SELECT event_id, CASE event_type WHEN 'view' THEN 'primary' ELSE 'secondary' END AS signal FROM e WHERE event_type = 'view' OR event_type = 'click' AND NOT EXISTS (SELECT 1 FROM e v WHERE v.event_type = 'view' AND v.rec_id = e.rec_id AND abs(v.t - e.t) <= 36000)", "e"))
def h02(s, d):
    pick = lambda k: of_type(s, d, k).select("rec_id", "t", "event_id")
    return O.merge_signals(pick("view"), pick("click"), BY, 36000.0).select("event_id", "signal")


@query("h03_dedupe_adjacent", sql("SELECT event_id FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY t) QUALIFY row_number() OVER w > 1 AND event_type <> lag(event_type) OVER w", "e"))
def h03(s, d):
    return O.dedupe_adjacent(recordings(s, d), BY, "event_type").select("event_id")


@query("h04_roster", sql("SELECT l_returnflag AS name FROM lineitem UNION SELECT l_linestatus FROM lineitem"))
def h04(s, d):
    return O.roster(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("h05_duplicate_ids", sql("+a AS (SELECT doc, part % 40 AS id, 'a' AS tb FROM segments WHERE flag = 'A' UNION ALL SELECT doc, part % 40, 'b' FROM segments WHERE flag <> 'A') SELECT doc, id, tb AS \"table\", row_number() OVER (PARTITION BY doc, id ORDER BY tb) AS k FROM a QUALIFY k > 1", "segments"))
def h05(s, d):
    g = segments(s, d).withColumn("id", F.col("part") % 40)
    return O.duplicate_ids({"a": g.where("flag = 'A'"), "b": g.where("flag <> 'A'")}, ["doc"])


@query("h06_promote", sql("SELECT doc, pos, (source + 1)::BIGINT AS main, [part, source] AS alternates FROM segments", "segments"))
def h06(s, d):
    main, alts = O.promote(F.col("source"), F.array(F.col("part"), F.col("source") + 1), 2)
    return segments(s, d).select("doc", "pos", main.alias("main"), alts.alias("alternates"))


@query("h07_split_kept", sql("SELECT event_id, CASE WHEN value < 10 THEN 'quiet' WHEN event_type = 'error' THEN 'broken' END AS reason FROM e", "e"))
def h07(s, d):
    return O.split_kept(recordings(s, d), {"quiet": F.col("value") < 10, "broken": F.col("event_type") == "error"}).select("event_id", "reason")


@query("h08_upsert_status", sql("+ex AS (SELECT doc * 100 + start AS frame, min(flag) AS note FROM segments WHERE pos <= 2 GROUP BY 1), inc AS (SELECT doc * 100 + start AS frame, doc, pos, flag AS note FROM segments WHERE pos >= 2), r AS (SELECT inc.*, ex.note AS old, first_value(inc.note) OVER w AS f, row_number() OVER w AS k FROM inc LEFT JOIN ex USING (frame) WINDOW w AS (PARTITION BY frame ORDER BY doc, pos)) SELECT doc, pos, CASE WHEN coalesce(old, CASE WHEN k > 1 THEN f END) IS NULL THEN 'added' WHEN coalesce(old, f) = note THEN 'unchanged' ELSE 'refused' END AS status FROM r", "segments"))
def h08(s, d):
    g = segments(s, d).select((F.col("doc") * 100 + F.col("start")).alias("frame"), "doc", "pos", F.col("flag").alias("note")).withColumn("at", F.struct("doc", "pos"))
    old = g.where("pos <= 2").groupBy("frame").agg(F.min("note").alias("note"))
    return O.upsert_status(old, g.where("pos >= 2"), "frame", ["note"], "at").select("doc", "pos", "status")


@query("h09_requested_points", sql("+b AS (SELECT rec_id, min(t) AS first, max(t) AS last FROM e WHERE event_type = 'view' GROUP BY 1), p AS (SELECT DISTINCT rec_id, floor(t)::BIGINT AS \"at\" FROM e) SELECT p.rec_id, \"at\", coalesce(\"at\" >= first AND \"at\" < last, FALSE) AS ok FROM p LEFT JOIN b USING (rec_id)", "e"))
def h09(s, d):
    b = of_type(s, d, "view").groupBy("rec_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return O.requested_points(recordings(s, d), b, BY)


@query("h10_stack_labels", sql("SELECT rec_id, t, event_type AS kind FROM e WHERE event_type IN ('error', 'signup')", "e"))
def h10(s, d):
    pick = lambda k: of_type(s, d, k).select("rec_id", "t")
    return O.union_events(error=pick("error"), signup=pick("signup"))


def _found(df):
    return df.select("doc", "rule", "id", "message", "pos")


def _j(name, body, *ctes):
    return query(name, sql(body, *ctes))


@_j("j01_rule_shape", "SELECT doc, 'E1' AS rule, id, message, 0::BIGINT AS pos FROM (SELECT DISTINCT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 'name' ELSE 'extra' END AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'missing' ELSE 'unknown key' END AS message FROM orders WHERE o_orderkey % 3 < 2)")
def j01(s, d):
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, F.create_map(F.lit("id"), F.lit("1"))).when(k % 3 == 1, F.create_map(*map(F.lit, ("id", "1", "name", "x", "extra", "y")))).otherwise(F.create_map(*map(F.lit, ("id", "1", "name", "x"))))
    return _found(R.rule_shape(read(s, d, "orders").select(k.alias("doc"), body.alias("body")).dropDuplicates(["doc"]), ["id", "name"], ["id", "name"]))


@_j("j02_rule_duplicate_id", "SELECT doc, 'E2' AS rule, (part % 40)::VARCHAR AS id, 'id used before' AS message, pos FROM segments QUALIFY row_number() OVER (PARTITION BY doc, part % 40 ORDER BY pos) > 1", "segments")
def j02(s, d):
    return _found(R.rule_duplicate_id(segments(s, d).withColumn("k", F.col("part") % 40), "k"))


@_j("j03_rule_range", "SELECT doc, 'E3' AS rule, pos::VARCHAR AS id, 'in is not before out' AS message, pos FROM segments WHERE source % 50 >= duration", "segments")
def j03(s, d):
    return _found(R.rule_range(segments(s, d).withColumn("a", F.col("source") % 50), "pos", "a", "duration"))


@_j("j04_rule_reference", "+n AS (SELECT p_size AS k, count(*) AS n FROM part WHERE p_size < 30 GROUP BY 1) SELECT doc, 'E4' AS rule, pos::VARCHAR AS id, CASE WHEN n IS NULL THEN 'undeclared' ELSE 'ambiguous' END AS message, pos FROM segments LEFT JOIN n ON k = duration WHERE n IS NULL OR n > 1", "segments")
def j04(s, d):
    return _found(R.rule_reference(segments(s, d).withColumn("k", F.col("duration").cast("int")), read(s, d, "part").where("p_size < 30").select(F.col("p_size").alias("k")), "pos", "k"))


_MEDIA = "md AS (SELECT s_suppkey AS source, 0 AS first, CASE WHEN s_suppkey % 5 > 0 THEN 20 + s_nationkey END AS last, s_suppkey % 7 = 0 AS still, CASE WHEN s_suppkey % 4 = 0 THEN 30.0 ELSE 25.0 END AS fps FROM supplier)"


def _media(s, d):
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select(k.alias("source"), F.lit(0).alias("first"), F.when(k % 5 > 0, 20 + F.col("s_nationkey")).alias("last"), (k % 7 == 0).alias("still"), F.when(k % 4 == 0, 30.0).otherwise(25.0).alias("fps"), (k % 3 > 0).alias("has_audio"))


@_j("j05_rule_bounds", f"+{_MEDIA} SELECT doc, CASE WHEN last IS NULL THEN 'W9' ELSE 'E5' END AS rule, pos::VARCHAR AS id, CASE WHEN last IS NULL THEN 'unknown bounds' ELSE 'outside the media' END AS message, pos FROM segments JOIN md USING (source) WHERE NOT still AND (last IS NULL OR duration > last)", "segments")
def j05(s, d):
    return _found(R.rule_bounds(segments(s, d).withColumn("zero", F.lit(0)), _media(s, d), "pos", "source", "zero", "duration"))


@_j("j06_rule_rate", f"+{_MEDIA} SELECT doc, 'E6' AS rule, pos::VARCHAR AS id, 'rate differs' AS message, pos FROM segments JOIN md USING (source) WHERE abs(fps - 25) > 0.01", "segments")
def j06(s, d):
    return _found(R.rule_rate(segments(s, d), _media(s, d), "pos", "source", 25.0))


@_j("j07_rule_audio", f"+{_MEDIA}, a AS (SELECT doc, min(source) AS source, sum(duration) AS stop FROM segments GROUP BY doc) SELECT doc, 'E7' AS rule, source::VARCHAR AS id, CASE WHEN source % 3 = 0 THEN 'has no audio' ELSE 'outside the media' END AS message, 0::BIGINT AS pos FROM a JOIN md USING (source) WHERE source % 3 = 0 OR stop > last", "segments")
def j07(s, d):
    a = segments(s, d).groupBy("doc").agg(F.min("source").alias("source"), F.sum("duration").alias("stop"))
    return _found(R.rule_audio(a, _media(s, d), "source"))


@_j("j08_rule_alternate_length", "SELECT doc, 'E8' AS rule, pos || '#' || k AS id, 'alternate of another length' AS message, pos FROM (SELECT *, unnest([duration, source % 50]) AS alt, unnest([0, 1]) AS k FROM segments) WHERE alt <> duration", "segments")
def j08(s, d):
    return _found(R.rule_alternate_length(segments(s, d).withColumn("alts", F.array(F.col("duration"), F.col("source") % 50)), "pos", "alts"))


@_j("j09_rule_overlay", "+o AS (SELECT doc, pos, part % 5 + 1 AS anchor, source % 60 - 5 AS off, 40 AS dur FROM segments), t AS (SELECT doc, sum(duration) AS total FROM segments GROUP BY 1), m AS (SELECT o.doc, o.pos, CASE WHEN s.doc IS NULL THEN 'no such anchor' WHEN off < 0 OR off >= s.duration THEN 'offset outside the anchor' WHEN s.start + off + dur > total THEN 'past the end' END AS message FROM o LEFT JOIN segments s ON s.doc = o.doc AND s.pos = o.anchor JOIN t ON t.doc = o.doc) SELECT doc, 'E9' AS rule, pos::VARCHAR AS id, message, pos FROM m WHERE message IS NOT NULL", "segments")
def j09(s, d):
    g = segments(s, d)
    o = g.select("doc", "pos", (F.col("part") % 5 + 1).alias("anchor"), (F.col("source") % 60 - 5).alias("offset"), F.lit(40).alias("duration"))
    return _found(R.rule_overlay(o, g, g.groupBy("doc").agg(F.sum("duration").alias("total")), "pos"))


@_j("j10_rule_overlap", "+x AS (SELECT doc, pos, start, start + duration + source % 9 AS stop FROM segments), m AS (SELECT *, max((stop, -pos)) OVER (PARTITION BY doc ORDER BY start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x) SELECT doc, 'E10' AS rule, pos::VARCHAR AS id, 'overlaps ' || (-m[2]) AS message, pos FROM m WHERE m[1] > start", "segments")
def j10(s, d):
    return _found(R.rule_overlap(segments(s, d).withColumn("stop", F.col("start") + F.col("duration") + F.col("source") % 9), "pos"))


@_j("j11_rule_tail", "SELECT doc, 'E12' AS rule, max(pos)::VARCHAR AS id, 'tail longer than the last item' AS message, max(pos) AS pos FROM segments GROUP BY doc HAVING 25 > arg_max(duration, pos)", "segments")
def j11(s, d):
    g = segments(s, d)
    return _found(R.rule_tail(g, g.select("doc").distinct().withColumn("tail", F.lit(25))))


@_j("j12_rule_short", "SELECT doc, 'W1' AS rule, pos::VARCHAR AS id, 'short' AS message, pos FROM segments WHERE duration < 12", "segments")
def j12(s, d):
    return _found(R.rule_short(segments(s, d), "pos"))


@_j("j13_rule_span_mismatch", "SELECT doc, 'W2' AS rule, doc::VARCHAR AS id, 'audio span is not the total' AS message, 0::BIGINT AS pos FROM segments GROUP BY doc HAVING sum(duration) <> doc % 300", "segments")
def j13(s, d):
    g = segments(s, d)
    return _found(R.rule_span_mismatch(g, g.select("doc", (F.col("doc") % 300).alias("span")).distinct()))


@_j("j14_rule_trailing_gap", "+l AS (SELECT doc, arg_max(source % 3, pos) AS g, max(start + duration) AS z, max(start + part % 40) AS c FROM segments GROUP BY doc) SELECT doc, 'W8' AS rule, doc::VARCHAR AS id, 'black at the end' AS message, 0::BIGINT AS pos FROM l WHERE g > 0 AND c < z + g", "segments")
def j14(s, d):
    g = segments(s, d)
    return _found(R.rule_trailing_gap(g.withColumn("gap", F.col("source") % 3), g.select("doc", (F.col("start") + F.col("part") % 40).alias("stop"))))


@_j("j15_rule_fade_fit", "SELECT doc, 'T4' AS rule, pos::VARCHAR AS id, 'fades longer than the item' AS message, pos FROM segments WHERE source % 20 + part % 20 > duration AND duration > 0", "segments")
def j15(s, d):
    return _found(R.rule_fade_fit(segments(s, d).withColumns({"fade_in": F.col("source") % 20, "fade_out": F.col("part") % 20}), "pos"))


@_j("j16_rule_exclusive_fields", "+x AS (SELECT doc, pos, CASE WHEN source % 2 = 0 THEN 'text' ELSE 'image' END AS rt, CASE WHEN part % 3 > 0 THEN 'a' END AS template, CASE WHEN part % 5 > 2 THEN 'b' END AS asset FROM segments), y AS (SELECT doc, pos, unnest(list_filter([CASE WHEN rt = 'text' AND template IS NULL THEN 'template missing' END, CASE WHEN rt = 'text' AND asset IS NOT NULL THEN 'asset not allowed' END, CASE WHEN rt = 'image' AND asset IS NULL THEN 'asset missing' END, CASE WHEN rt = 'image' AND template IS NOT NULL THEN 'template not allowed' END], lambda v: v IS NOT NULL)) AS message FROM x) SELECT doc, 'T6' AS rule, pos::VARCHAR AS id, message, pos FROM y", "segments")
def j16(s, d):
    g = segments(s, d).withColumns({"route": F.when(F.col("source") % 2 == 0, "text").otherwise("image"), "template": F.when(F.col("part") % 3 > 0, "a"), "asset": F.when(F.col("part") % 5 > 2, "b")})
    return _found(R.rule_exclusive_fields(g, "pos", "route", {"text": "template", "image": "asset"}))


@_j("j17_rule_anchor_once", "+k AS (SELECT DISTINCT doc, part % 4 AS song FROM segments), a AS (SELECT doc, source % 4 AS song, count(*) AS n FROM segments GROUP BY ALL) SELECT doc, 'T7' AS rule, song::VARCHAR AS id, CASE WHEN n IS NULL THEN 'no anchor' ELSE 'several anchors' END AS message, 0::BIGINT AS pos FROM k LEFT JOIN a USING (doc, song) WHERE coalesce(n, 0) <> 1", "segments")
def j17(s, d):
    g = segments(s, d)
    return _found(R.rule_anchor_once(g.select("doc", (F.col("part") % 4).alias("song")).distinct(), g.select("doc", (F.col("source") % 4).alias("song")), "song"))


@_j("j18_rule_asset", "SELECT doc, CASE WHEN p_size IS NULL THEN 'T10' ELSE 'T11' END AS rule, pos::VARCHAR AS id, CASE WHEN p_size IS NULL THEN 'asset missing' ELSE 'too few frames' END AS message, pos FROM segments LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = part WHERE p_size IS NULL OR p_size < duration", "segments")
def j18(s, d):
    return _found(R.rule_asset(segments(s, d), read(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("frames")), "pos", "part"))


@_j("j19_rule_unused", "+x AS (SELECT DISTINCT doc, source % 4 AS k FROM segments), y AS (SELECT DISTINCT doc, part % 4 AS k FROM segments) SELECT doc, 'W2' AS rule, k::VARCHAR AS id, 'never used' AS message, 0::BIGINT AS pos FROM x ANTI JOIN y USING (doc, k) UNION ALL SELECT doc, 'W1', k::VARCHAR, 'without children', 0 FROM y ANTI JOIN x USING (doc, k)", "segments")
def j19(s, d):
    g = segments(s, d)
    x, y = (g.select("doc", (F.col(c) % 4).alias("k")).distinct() for c in ("source", "part"))
    return _found(R.rule_unused(x, y, "k").union(R.rule_empty_parent(y, x, "k")))


@_j("j20_rule_readback", "+x AS (SELECT doc, pos, CASE WHEN part % 7 = 0 THEN 'opens' END AS clipped, source % 4 AS rep, CASE WHEN part % 11 > 0 THEN part % 10 / 10.0 END AS conf, coalesce(lag(source) OVER (PARTITION BY doc ORDER BY pos) = source, FALSE) AS jump FROM segments), y AS (SELECT doc, pos, unnest(list_filter([CASE WHEN clipped IS NOT NULL THEN 'W3:clipped where it opens' END, CASE WHEN rep >= 2 THEN 'W4:take repeated' END, CASE WHEN conf IS NULL THEN 'W5:no transcript' END, CASE WHEN conf < 0.5 THEN 'W6:low confidence' END, CASE WHEN jump THEN 'W7:jump not covered' END], lambda v: v IS NOT NULL)) AS m FROM x) SELECT doc, m[1:2] AS rule, pos::VARCHAR AS id, m[4:] AS message, pos FROM y", "segments")
def j20(s, d):
    from ..operators.windows import jump_seams

    g = jump_seams(segments(s, d), ["doc"]).withColumns({"clipped": F.when(F.col("part") % 7 == 0, "opens"), "repeated": F.col("source") % 4, "confidence": F.when(F.col("part") % 11 > 0, F.col("part") % 10 / 10)})
    return _found(R.rule_readback(g, "pos"))


@_j("j21_findings_gate", "SELECT doc FROM segments GROUP BY doc HAVING NOT bool_or(source % 50 >= duration)", "segments")
def j21(s, d):
    g = segments(s, d).withColumn("a", F.col("source") % 50)
    f = R.findings(R.rule_range(g, "pos", "a", "duration"), R.rule_short(g, "pos"))
    return R.gate(g.select("doc").distinct(), f)
