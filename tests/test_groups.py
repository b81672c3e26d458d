"""Folds over groups pass through sorted tasks: keys with nulls, groups over several batches, work that doesn't grow with groups."""

import math

from pyspark.sql import functions as F

from chronoframe.operators import islands as I
from chronoframe.operators.folds import in_groups
from chronoframe.operators.udf import mergeable_aggregate
from chronoframe.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def small_batches(spark, run):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        return run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_over_batches(spark):
    df = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.col("id") % 9 + 2**60).alias("k"), (F.col("id") % 2 == 0).alias("b"), F.col("id").alias("v")).repartition(5)
    want = {(None if k == 0 else k + 2**60, b): [v for v in range(500) if v % 9 == k and (v % 2 == 0) == b] for k in range(9) for b in (True, False)}
    whole = in_groups(df, ["k", "b"], ["v"], lambda g: [(g["v"].tolist(),)], "vs array<long>")
    got = small_batches(spark, lambda: {(r.k, r.b): r.vs for r in whole.collect()})
    assert got == want
    pieces = in_groups(df, ["k", "b"], ["v"], lambda g, n: ([((n or 0) + i, int(v)) for i, v in enumerate(g["v"])], (n or 0) + len(g["v"])), "i long, v long", carry=True)
    rows = small_batches(spark, pieces.collect)
    assert sorted((r.v, want[r.k, r.b][r.i]) for r in rows) == [(v, v) for v in range(500)]
    assert in_groups(df.where("false"), ["k"], ["v"], lambda g: [(1,)], "n long").collect() == []


def test_small_groups_share_tasks(spark, sf_dir):
    for name in ("f18_span_groups", "f19_note_spans", "f20_legs", "g05_thin", "i07_phrase_boundaries", "l03_mergeable_aggregate"):
        assert "FlatMapGroupsInPandas" not in plan(QUERIES[name](spark, sf_dir)), name


def test_spaced_top_k_sorts_do_not_grow_with_k(spark, sf_dir):
    text = plan(QUERIES["i19_event_rank"](spark, sf_dir))
    assert text.count("Join") <= 1 and text.count("Scan parquet") <= 2


def test_spaced_top_k_over_batches_of_a_broadcast_floor(spark):
    df = spark.range(4000).select((F.col("id") % 40).alias("k"), F.col("id").alias("id"), (F.col("id") * 37 % 1000).cast("double").alias("t"), (F.col("id") * 7919 % 4001).cast("double").alias("s"))
    got = small_batches(spark, lambda: sorted((r.k, r.rank, r.id) for r in I.spaced_top_k(df, ["k"], "id", "s", 30.0, 3).collect()))
    want = []
    for k in range(40):
        picked = []
        for s, t, i in sorted((-(i * 7919 % 4001), i * 37 % 1000, i) for i in range(k, 4000, 40)):
            if len(picked) < 3 and all(abs(t - p) >= 30 for p in picked):
                picked.append(t)
                want.append((k, len(picked), i))
    assert got == sorted(want)


def test_mergeable_aggregate_updates_about_once_a_key(spark):
    df = spark.range(6000).select((F.col("id") % 600).alias("k"), F.lit(1.0).alias("v")).repartition(6)
    agg = mergeable_aggregate(df, ["k"], ["v"], lambda: (0, 0), lambda s, rows: (s[0] + len(rows), s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s, "n long, calls long")
    rows = agg.collect()
    assert [r.n for r in rows] == [10] * 600 and sum(r.calls for r in rows) <= 610


def _events(tmp_path, rows):
    import duckdb

    duckdb.connect().execute(f"copy (select event_id::bigint as event_id, ts::timestamp as ts, user_id::bigint as user_id, 'click' as event_type, value::double as value from (values {rows}) x(event_id, ts, user_id, value)) to '{tmp_path}/events.parquet' (format parquet)")


def test_empty_item_without_media_stays_if_nothing_holds_its_start(spark, tmp_path):
    """Every third id has no media; a value of 0 makes an empty item."""
    import duckdb

    from chronoframe.plans import ORACLES

    _events(tmp_path, "(3, '2024-01-01 10:00:00', 1, 0), (4, '2024-01-02 10:00:00', 1, 10), (6, '2024-01-02 11:00:00', 1, 0), (9, '2024-01-02 10:00:00', 1, 0), (12, '2024-01-03 10:00:00', 2, 5), (15, '2024-01-05 10:00:00', 2, 0)")
    con = duckdb.connect()
    con.execute(f"set timezone='UTC'; create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    want = sorted(con.execute(ORACLES["f17_drop_covered"]).fetchall())
    assert (1, 3) in want and (2, 15) in want and (1, 6) not in want
    assert sorted(map(tuple, QUERIES["f17_drop_covered"](spark, str(tmp_path)).collect())) == want


def test_levels_of_silent_windows_have_no_floor(spark, tmp_path):
    """Windows of zeros alone, of no values and of values under -120 dB, as in the SQL; the operator keeps its floor."""
    import duckdb

    from chronoframe.operators import windows as W
    from chronoframe.plans import ORACLES
    from chronoframe.plans.registry import recordings

    days = [f"2024-01-0{d} 10:00:00" for d in range(1, 8)]
    rows = [(1, v) for v in (5, 0, 0, 0, "null", "null", 7)] + [(2, 0), (3, "null"), (4, "1e-9"), (4, 0)]
    seen = [sum(u == rows[j][0] for j in range(i)) for i, (u, _) in enumerate(rows)]
    _events(tmp_path, ", ".join(f"({i}, '{days[k]}', {u}, {v})" for i, ((u, v), k) in enumerate(zip(rows, seen))))
    con = duckdb.connect()
    con.execute(f"set timezone='UTC'; create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    want = sorted(con.execute(ORACLES["e25_window_table"]).fetchall(), key=lambda r: r[:2])
    assert {(-math.inf, -math.inf), (None, None)} <= {r[2:4] for r in want} and any(-math.inf < (r[3] or 0) < -120 for r in want)
    assert sorted(map(tuple, QUERIES["e25_window_table"](spark, str(tmp_path)).collect()), key=lambda r: r[:2]) == want
    v = F.col("value")
    floored = W.window_table(recordings(spark, str(tmp_path)), ["rec_id"], 86400.0, 43200.0, [v], v, F.lit(True)).where("rec_id > 1").collect()
    assert len(floored) == 3 and {(r.lufs, r.rms) for r in floored} == {(-120.0, -120.0)}
