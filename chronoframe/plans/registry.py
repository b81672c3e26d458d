"""The registered queries and their SQL, and the recordings they read from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import seconds_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the SQL, by name; sql("...", "e", "items") puts them in front.
CTES = {
    "e": "e AS (SELECT user_id AS rec_id, epoch_us(ts) / 1e6 AS t, event_id, event_type, value FROM events)",
    "items": "items AS (SELECT rec_id, event_id, t, lead(t) OVER (PARTITION BY rec_id ORDER BY t) - t AS seconds, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS t_end, event_type AS clip, value FROM e QUALIFY seconds IS NOT NULL)",
    "level": "level AS (SELECT rec_id, floor(t / 3600) * 3600 AS t, round(avg(value), 6) AS level FROM e GROUP BY ALL)",
    "sections": "sections AS (SELECT rec_id, t AS start, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS stop, event_id AS section FROM e WHERE event_type = 'signup')",
    "segments": "segments AS (SELECT l_orderkey AS doc, row_number() OVER w AS pos, l_suppkey AS source, l_partkey AS part, l_quantity::BIGINT AS duration, coalesce(sum(l_quantity::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, l_returnflag AS flag FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))",
}


def sql(body: str, *ctes: str) -> str:
    return ("WITH " + ", ".join(CTES[c] for c in ctes) + (", " if body.lstrip().startswith("+") else " ") if ctes else "") + body.lstrip().lstrip("+")


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            ORACLES[name] = text
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, t, event_id, event_type, value: every user's events as one recording."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), seconds_of(F.col("ts")).alias("t"), "event_id", "event_type", "value")


def of_type(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    return recordings(spark, sf_dir).where(F.col("event_type").isin(*types))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, event_id, t, seconds, t_end, clip, value: each event lasts until the next."""
    after = F.lead("t").over(Window.partitionBy("rec_id").orderBy("t"))
    return recordings(spark, sf_dir).select("rec_id", "event_id", "t", (after - F.col("t")).alias("seconds"), after.alias("t_end"), F.col("event_type").alias("clip"), "value").where("seconds is not null")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, t, level: hourly mean of value."""
    return recordings(spark, sf_dir).groupBy("rec_id", (F.floor(F.col("t") / 3600) * 3600).cast("double").alias("t")).agg(F.round(F.avg("value"), 6).alias("level"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, start, stop, section: from one signup to the next; the last is open."""
    e = of_type(spark, sf_dir, "signup")
    return e.select("rec_id", F.col("t").alias("start"), F.lead("t").over(Window.partitionBy("rec_id").orderBy("t")).alias("stop"), F.col("event_id").alias("section"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, pos, source, part, duration, start, flag: the lines of an order as an ordered document, laid end to end."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    duration = F.col("l_quantity").cast("long")
    start = F.coalesce(F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).cast("long").alias("pos"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("part"), duration.alias("duration"), start.alias("start"), F.col("l_returnflag").alias("flag"))
