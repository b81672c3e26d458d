"""Queries over the streaming forms: the events as a stream, read until there is no more, into a table in the shared folder.

Rows that a watermark still holds back when the stream ends are not in the table; the SQL says which."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import seconds_of
from ..sources.catalog import shared_path
from ..streaming import streams as T
from .registry import query, read, sections, sql


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("user_id").alias("rec_id"), F.timestamp_micros(F.round(seconds_of(F.col("ts")) * 1_000_000).cast("long")).alias("ts"), "event_type", "value", "event_id")


def _run(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out, path = make(_stream(spark, sf_dir)), shared_path(spark, "stream")
    running = out.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def _seconds(c: str):
    return (F.unix_micros(c) / 1e6).alias(c)


@query("k01_stream_levels", sql("+w AS (SELECT *, unnest([floor(t / 43200) * 43200, floor(t / 43200) * 43200 - 43200]) AS start FROM e) SELECT rec_id, start, count(*) AS n, round(avg(value * value), 6) AS mean_square FROM w WHERE start + 86400 <= (SELECT max(t) - 3600 FROM e) GROUP BY ALL", "e"))
def k01(s, d):
    out = _run(s, d, lambda x: T.stream_levels(x, ["rec_id"], "value", "1 day", "12 hours", "1 hour"))
    return out.select("rec_id", _seconds("start"), "n", F.round("mean_square", 6).alias("mean_square"))


@query("k02_stream_bursts", sql("+o AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) >= 21600, TRUE)::INT AS nw FROM e WHERE value >= 50), g AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY t) AS g FROM o) SELECT rec_id, min(t) AS start, max(t) + 21600 AS stop, count(*) AS rows, max(value) AS peak FROM g GROUP BY rec_id, g HAVING max(t) + 21600 <= (SELECT max(t) - 3600 FROM o)", "e"))
def k02(s, d):
    return _run(s, d, lambda x: T.stream_bursts(x, ["rec_id"], "value", 50.0, "6 hours", "1 hour")).select("rec_id", _seconds("start"), _seconds("stop"), "rows", "peak")


@query("k03_stream_state", sql("+g AS (SELECT *, coalesce(last_value(CASE WHEN value >= 50 THEN TRUE WHEN value < 15 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY t ROWS UNBOUNDED PRECEDING), FALSE) AS open FROM e) SELECT rec_id, t AS ts, open FROM g QUALIFY open <> coalesce(lag(open) OVER (PARTITION BY rec_id ORDER BY t), FALSE) AND t <= (SELECT floor((max(t) - 3600) * 1000) / 1000 FROM e)", "e"))
def k03(s, d):
    return _run(s, d, lambda x: T.stream_state(x, "rec_id", "value", 50.0, 15.0)).select("rec_id", _seconds("ts"), "open")


@query("k04_stream_enrich", sql("SELECT event_id, section FROM e LEFT JOIN sections s ON s.rec_id = e.rec_id AND s.start <= e.t AND e.t < coalesce(s.stop, 'infinity'::DOUBLE)", "e", "sections"))
def k04(s, d):
    spans = sections(s, d)
    at = lambda c: F.timestamp_micros(F.round(c * 1_000_000).cast("long"))
    spans = spans.select("rec_id", at(F.col("start")).alias("start"), F.coalesce(at(F.col("stop")), F.lit("9999-01-01").cast("timestamp")).alias("stop"), "section")
    return _run(s, d, lambda x: T.stream_enrich(x, spans, ["rec_id"]).select("event_id", "section"))


@query("k05_stream_dedupe", sql("SELECT event_id, t AS ts FROM e", "e"))
def k05(s, d):
    """Every row comes twice."""
    return _run(s, d, lambda x: T.stream_dedupe(x.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), ["event_id"], "1 hour").select("event_id", "ts")).select("event_id", _seconds("ts"))


@query("k06_stream_thin", sql("+k AS (SELECT rec_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT k.rec_id, (SELECT min(e.t) FROM e WHERE e.rec_id = k.rec_id AND e.t - k.t >= 86400) AS t FROM k WHERE k.t IS NOT NULL) SELECT rec_id, t AS ts FROM k WHERE t <= (SELECT floor((max(t) - 3600) * 1000) / 1000 FROM e)", "e").replace("WITH", "WITH RECURSIVE", 1))
def k06(s, d):
    return _run(s, d, lambda x: T.stream_thin(x, "rec_id", 86400.0)).select("rec_id", _seconds("ts"))
