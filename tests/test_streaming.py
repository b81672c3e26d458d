import os
import random

from pyspark.sql import functions as F

from chronoframe.operators import islands as I
from chronoframe.streaming import streams as S


def run(spark, tmp_path, sf_dir, make):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = raw.select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def batches(spark, tmp_path, files, make):
    """The rows (rec_id, seconds, value) of each file as one batch, one after the other."""
    source = tmp_path / "in"
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "rec_id long, t double, value double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
        df.coalesce(1).write.mode("append").parquet(str(source / f"b{k}"))
        for f in (source / f"b{k}").glob("*.parquet"):
            os.utime(f, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema("rec_id long, t double, value double, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.sql(f"select * from {name}").collect()


def test_thin_over_batches(spark, tmp_path):
    """Rows shuffled over batches within the allowed lateness give the rows of one batch; later ones are dropped."""
    rng = random.Random(1)
    rows = [(k, 1000.0 + i * 7.5 + k, 1.0) for k in (1, 2) for i in range(40)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 50))
    files = [rows[:25], rows[25:50], rows[50:], [(1, 9000.0, 1.0)], [(1, 1001.0, 1.0), (2, 9010.0, 1.0)], [(3, 20000.0, 1.0)]]
    got = sorted((r.rec_id, r.ts.timestamp()) for r in batches(spark, tmp_path, files, lambda s: S.stream_thin(s, "rec_id", 20.0, "60 seconds")))
    df = spark.createDataFrame([*rows, (1, 9000.0, 1.0), (2, 9010.0, 1.0)], "rec_id long, t double, value double")
    assert got == sorted((r.rec_id, r.t) for r in I.thin(df, ["rec_id"], 20.0).collect())


def test_gate_over_batches(spark, tmp_path):
    files = [[(1, 100.0, 9.0)], [(1, 50.0, 0.0), (1, 60.0, 9.0)], [(1, 200.0, 5.0), (1, 190.0, 0.0), (1, 195.0, 9.0)], [(2, 1000.0, 9.0)], [(1, 120.0, 0.0), (2, 3000.0, 5.0)], [(3, 90000.0, 0.0)]]
    make = lambda idle: lambda s: S.stream_state(s, "rec_id", "value", 8.0, 3.0, "100 seconds", idle)
    at = lambda rows: sorted((r.rec_id, r.ts.timestamp(), r.open) for r in rows)
    assert at(batches(spark, tmp_path / "a", files, make(None))) == [(1, 60.0, True), (1, 190.0, False), (1, 195.0, True), (2, 1000.0, True)]
    assert at(batches(spark, tmp_path / "b", files, make("500 seconds"))) == [(1, 60.0, True), (1, 190.0, False), (1, 195.0, True), (1, 700.0, False), (2, 1000.0, True), (2, 1500.0, False)]


def test_enrich_by_buckets(spark, tmp_path):
    """Rows before, in, between and after spans, one of them open."""
    at = lambda x: F.timestamp_micros((x * 1_000_000).cast("long"))
    spans = [(1, 10.0, 20.0, "a"), (1, 30.0, 500.0, "b"), (1, 600.0, 1e11, "open"), (2, 0.0, 5.0, "c")]
    catalog = spark.createDataFrame(spans, "rec_id long, a double, z double, name string").select("rec_id", at(F.col("a")).alias("start"), at(F.col("z")).alias("stop"), "name")
    rows = [(1, t, 0.0) for t in (5.0, 10.0, 19.9, 20.0, 31.0, 300.0, 499.0, 550.0, 600.0, 5e5)] + [(2, 4.0, 0.0), (2, 5.0, 0.0), (3, 1.0, 0.0)]
    got = batches(spark, tmp_path, [rows[:6], rows[6:]], lambda s: S.stream_enrich(s, catalog, ["rec_id"], "1 minute").select("rec_id", "t", "name"))
    want = [(k, t, next((n for r, a, z, n in spans if r == k and a <= t < z), None)) for k, t, _ in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_levels_bursts_and_dedupe(spark, sf_dir, tmp_path):
    levels = run(spark, tmp_path / "a", sf_dir, lambda s: S.stream_levels(s, ["rec_id"], "value", "1 day", "12 hours", "1 hour"))
    assert levels and all(r.n > 0 for r in levels)
    bursts = run(spark, tmp_path / "b", sf_dir, lambda s: S.stream_bursts(s, ["rec_id"], "value", 50.0, "6 hours", "1 hour"))
    assert bursts and all(r.rows >= 1 and r.stop > r.start for r in bursts)
    once = run(spark, tmp_path / "c", sf_dir, lambda s: S.stream_dedupe(s.unionByName(s), ["event_id"], "1 hour"))
    assert len(once) == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_keys_share_state_by_buckets(spark, tmp_path):
    """Six thousand keys, one of them null, take a timer a bucket."""
    key = F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id").cast("string")))
    at = lambda c: F.timestamp_seconds(c)
    rows = spark.range(6000).select(key.alias("name"), F.explode(F.array(F.lit(100), F.lit(105), F.lit(130))).alias("s")).select("name", at(F.col("s")).alias("ts"))
    rows.unionByName(spark.range(1).select(F.lit("last").alias("name"), at(F.lit(90_000)).alias("ts"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, ts timestamp").parquet(str(tmp_path / "in"))
    q = S.stream_thin(stream, "name", 20.0).writeStream.format("memory").queryName("by_buckets").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.table("by_buckets").groupBy("name").agg(F.sort_array(F.collect_list(F.unix_seconds("ts"))).alias("s")).collect()
    assert len(got) == 6000 and {r.name for r in got} == {None, *(f"k{i}" for i in range(1, 6000))}
    assert all(list(r.s) == [100, 130] for r in got)
    assert max(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress) <= 4096
