"""Queries over the scalar functions (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from .registry import items, query, read, recordings, sql

FLOORS = {"sharpness": 20.0, "clipped": 0.05, "stability": 0.5}


@query("b01_frames_from_seconds", sql("SELECT event_id, floor(round(value * (24000 / 1001.0)::DOUBLE, 9))::BIGINT AS f_in, ceil(round(value * (24000 / 1001.0)::DOUBLE, 9))::BIGINT AS f_out FROM events"))
def b01(spark, d):
    fps = 24000 / 1001
    return read(spark, d, "events").select("event_id", C.frames_from_seconds(F.col("value"), fps).alias("f_in"), C.frames_from_seconds(F.col("value"), fps, "out").alias("f_out"))


_TC = "format('{:02d}:{:02d}:{:02d}:{:02d}', n // 25 // 3600, n // 25 // 60 % 60, n // 25 % 60, n % 25)"


@query("b02_timecode", sql(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey > 0 THEN '-' ELSE '' END || {_TC} AS tc FROM (SELECT p_partkey, p_partkey * 977 AS n FROM part)"))
def b02(spark, d):
    n = F.col("p_partkey") * 977
    return read(spark, d, "part").select("p_partkey", C.timecode(F.when(F.col("p_partkey") % 2 == 0, -n).otherwise(n), 25).alias("tc"))


@query("b03_frames_from_timecode", sql("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 30 >= 25 THEN NULL ELSE (CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END) * ((p_partkey % 60) * 25 + p_partkey % 30) END AS frames FROM part"))
def b03(spark, d):
    k = F.col("p_partkey")
    text = F.format_string("%s00:00:%02d%s%02d%s", F.when(k % 5 == 0, " -").otherwise(" "), k % 60, F.when(k % 7 == 0, ";").otherwise(":"), k % 30, F.when(k % 11 == 0, "x").otherwise("\t "))
    return read(spark, d, "part").select("p_partkey", C.frames_from_timecode(text, 25).alias("frames"))


@query("b04_dual_time", sql(f"SELECT p_partkey, n AS frames, round(n / 25.0, 3)::DOUBLE AS seconds, {_TC} AS timecode, CASE WHEN n IS NOT NULL THEN 25.0::DOUBLE END AS fps FROM (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_partkey * 13 END AS n, p_size FROM part)"))
def b04(spark, d):
    frames = F.when(F.col("p_size") % 5 > 0, F.col("p_partkey") * 13)
    return read(spark, d, "part").select("p_partkey", C.dual_time(frames, 25.0).alias("x")).select("p_partkey", "x.*")


@query("b05_to_frames", sql("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN floor(round((p_size + 0.5) * 25, 9))::BIGINT WHEN 2 THEN p_size * 25 + 7 END::BIGINT AS frames FROM part"))
def b05(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    text = F.when(k == 0, n.cast("string")).when(k == 1, F.concat(n.cast("string"), F.lit(".5"))).when(k == 2, F.format_string("00:00:%02d:07", n)).otherwise("?")
    return read(spark, d, "part").select("p_partkey", C.to_frames(text, 25).alias("frames"))


@query("b06_ranges_overlap", sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT - 10 AS duration, (10 < 30 AND 25 < l_quantity) AS overlap FROM lineitem"))
def b06(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.duration_frames(F.lit(10), q.cast("long")).alias("duration"), C.ranges_overlap(F.lit(10), q, F.lit(25), F.lit(30)).alias("overlap"))


@query("b07_touches", sql("SELECT event_id, t < 1704240000 AND t + seconds > 1704153600 AS touches FROM items", "e", "items"))
def b07(spark, d):
    return items(spark, d).select("event_id", C.touches(F.col("t"), F.col("t") + F.col("seconds"), F.lit(1704153600), F.lit(1704240000)).alias("touches"))


@query("b08_strictly_inside", sql("SELECT event_id, (10 + 0.5 < value AND value < 60 - 0.5) AS inside FROM e", "e"))
def b08(spark, d):
    return recordings(spark, d).select("event_id", C.strictly_inside(F.lit(10.0), F.lit(60.0), F.col("value"), 0.5).alias("inside"))


@query("b09_split_version", sql("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_type || ' v' || p_size ELSE p_type END AS name, p_type AS base, CASE WHEN p_size % 3 > 0 THEN p_size::BIGINT END AS version, coalesce(max(CASE WHEN p_size % 3 > 0 THEN p_size::BIGINT END) OVER (PARTITION BY p_type), 0) + 1 AS next FROM part"))
def b09(spark, d):
    from pyspark.sql import Window

    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.concat("p_type", F.lit(" v"), F.col("p_size").cast("string"))).otherwise(F.col("p_type")).alias("name"))
    p = p.withColumns({"base": C.version_base(F.col("name")), "version": C.version_number(F.col("name"))})
    return p.withColumn("next", F.coalesce(F.max("version").over(Window.partitionBy("base")), F.lit(0)) + 1)


@query("b10_semitones", sql("SELECT event_id, round(CASE WHEN value > 0 THEN 12 * log2(440 / value) ELSE 0 END, 6) AS semitones FROM e", "e"))
def b10(spark, d):
    return recordings(spark, d).select("event_id", F.round(C.semitones(F.col("value"), F.lit(440.0)), 6).alias("semitones"))


@query("b11_levels", sql("SELECT event_id, round(CASE WHEN v > 0 THEN greatest(10 * log10(v), -120) ELSE -120 END, 6) AS dbfs, round(CASE WHEN v > 0 THEN greatest(10 * log10(v + v + v + v * 1.41::DOUBLE) - 0.691::DOUBLE, -120) ELSE -120 END, 6) AS lufs FROM (SELECT event_id, value / 1000 AS v FROM e)", "e"))
def b11(spark, d):
    v = F.col("value") / 1000
    return recordings(spark, d).select("event_id", F.round(C.dbfs(v), 6).alias("dbfs"), F.round(C.lufs([v, v, v, v]), 6).alias("lufs"))


@query("b12_clamp", sql("SELECT event_id, round(least(greatest(value / 50 - 1, 0), 1), 6) AS clamped, round(least(greatest((value - 1) / 39, 0), 1), 6) AS score FROM e", "e"))
def b12(spark, d):
    return recordings(spark, d).select("event_id", F.round(C.clamp01(F.col("value") / 50 - 1), 6).alias("clamped"), F.round(C.linear_score(F.col("value"), 40.0), 6).alias("score"))


@query("b13_parse_label", sql("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'lead' END AS role, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_mktsegment END AS subject, CASE c_custkey % 3 WHEN 0 THEN 'v' || c_nationkey WHEN 1 THEN c_mktsegment END AS voice FROM customer"""))
def b13(spark, d):
    k = F.col("c_custkey") % 3
    obj = F.to_json(F.struct(F.lit("lead").alias("role"), F.col("c_mktsegment").alias("subject"), F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("voice")))
    entry = F.when(k == 0, obj).when(k == 1, F.concat("c_mktsegment", F.lit("-bright"))).otherwise("  ")
    return read(spark, d, "customer").select("c_custkey", C.parse_label(entry).alias("x")).select("c_custkey", "x.*")


@query("b14_label_kind", sql("SELECT event_id, CASE event_type WHEN 'view' THEN 'ensemble' WHEN 'click' THEN 'player' WHEN 'error' THEN 'other' WHEN 'signup' THEN NULL ELSE 'player' END AS kind FROM events"))
def b14(spark, d):
    t = F.col("event_type")
    subject = F.when(t == "view", "ensemble").when(t == "click", "follow cam").when(t == "signup", None).otherwise(t)
    return read(spark, d, "events").select("event_id", C.label_kind(subject, ["purchase"]).alias("kind"))


_NAMES = "a.PNG b.jpg c.jpeg d.tif e.tiff f.exr g.dpx h.tga i.ai j.eps k.psd l.svg m.aac n.AIF o.aiff p.flac q.m4a r.mp3 s.ogg t.Wav u.mov v.mp4 w.mxf x.txt noext y.wav.mov z.mov.png .png".split()
_KINDS = ["graphics"] * 12 + ["audio"] * 8 + ["footage"] * 6 + ["graphics", "footage"]


@query("b15_classify_path", f"SELECT p_partkey, ({_KINDS})[(p_partkey % {len(_KINDS)} + 1)::INT] AS kind FROM part")
def b15(spark, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", C.classify_path(F.concat(F.lit("/a.png/b.wav/"), name)).alias("kind"))


@query("b16_first_non_empty", sql("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS value, CASE WHEN c_custkey % 3 = 0 THEN 'name' ELSE 'segment' END AS source FROM customer"))
def b16(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_name")).when(F.col("c_custkey") % 3 == 1, "  ")
    return read(spark, d, "customer").select("c_custkey", C.first_non_empty([("name", name), ("segment", F.col("c_mktsegment"))]).alias("x")).select("c_custkey", "x.*")


@query("b17_frame_bounds", sql("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_partkey + 51 WHEN 1 THEN p_partkey + 40 WHEN 2 THEN p_partkey + 50 END AS end_exclusive FROM part"))
def b17(spark, d):
    k, s = F.col("p_size") % 4, F.col("p_partkey")
    end = C.frame_bounds(s, F.when(k == 0, s + 50), F.when(k == 1, F.lit(40)), F.when(k == 2, "00:00:02:00"), 25)
    return read(spark, d, "part").select("p_partkey", end.alias("end_exclusive"))


@query("b18_unfold_sequence_name", sql("SELECT p_partkey, 'x.' || lpad(p_size::VARCHAR, 3, '0') || '.png' AS path FROM part"))
def b18(spark, d):
    return read(spark, d, "part").select("p_partkey", C.unfold_sequence_name(F.format_string("x.[%03d-999].png", F.col("p_size"))).alias("path"))


@query("b19_spoken_tokens", sql(r"SELECT conv_id, turn, len(tk)::BIGINT AS n, array_to_string(tk, ' ') AS tokens FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: trim(w, '.,!?')), lambda w: w <> '') AS tk FROM conversations)"))
def b19(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", C.spoken_tokens(F.col("text")).alias("k")).select("conv_id", "turn", F.size("k").cast("long").alias("n"), F.array_join("k", " ").alias("tokens"))


@query("b20_bar_line_strength", sql("SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN 1.0 WHEN event_type = 'view' THEN 0.6 ELSE 0.15 END::DOUBLE AS strength FROM events"))
def b20(spark, d):
    return read(spark, d, "events").select("event_id", C.bar_line_strength(F.col("event_type") == "view", F.col("event_id") + 1).alias("strength"))


@query("b21_floor_misses", sql("SELECT event_id, array_to_string(list_filter([CASE WHEN value < 20 THEN 'soft' END, CASE WHEN value / 1000 > 0.05 THEN 'clipped' END, CASE WHEN event_type <> 'view' AND value / 100 < 0.5 THEN 'shaky' END], lambda x: x IS NOT NULL), ',') AS misses, round(least(greatest((20 - value) / 20, (value / 1000 - 0.05::DOUBLE) / 0.05::DOUBLE, coalesce(CASE WHEN event_type <> 'view' THEN (0.5::DOUBLE - value / 100) / 0.5::DOUBLE END, 0), 0), 1), 6) AS severity FROM events"))
def b21(spark, d):
    v = F.col("value")
    stability = F.when(F.col("event_type") != "view", v / 100)
    return read(spark, d, "events").select("event_id", F.array_join(C.floor_misses(v, v / 1000, stability, FLOORS), ",").alias("misses"), F.round(C.severity(v, v / 1000, stability, FLOORS), 6).alias("severity"))


@query("b22_span_filter", sql("SELECT event_id, t FROM e WHERE t >= 1704153600 AND t < 1704240000", "e"))
def b22(spark, d):
    from ..sources.catalog import span_filter

    return span_filter(recordings(spark, d), 1704153600.0, 1704240000.0).select("event_id", "t")


@query("b23_step_reason", sql("SELECT event_id, CASE WHEN greatest(value / 100, 0.1) < 0.2 AND value % 10 < 2 THEN 'same angle and size' WHEN greatest(value / 100, 0.1) < 0.2 THEN 'same angle' WHEN value % 10 < 2 THEN 'same size' END AS reason FROM events"))
def b23(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", C.step_reason(v / 100, F.lit(0.1), v % 10 / 10).alias("reason"))
