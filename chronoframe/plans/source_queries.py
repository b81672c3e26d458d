"""Queries over sources and sinks: each writes the table to the shared folder in the form it reads, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog as K
from .registry import query, read, recordings, sql


@query("a01_read_catalog", sql("SELECT rec_id, 'events' AS kind, event_id, t FROM e WHERE event_type <> 'error'", "e"))
def a01(s, d):
    """One catalog a recording; the rows of errors have no time and go."""
    t = F.when(F.col("event_type") != "error", F.col("t"))
    row = F.struct(t.alias("t"), "event_id", F.col("value").alias("extra"))
    path = K.shared_path(s, "catalogs")
    recordings(s, d).groupBy("rec_id").agg(F.lit("events").alias("kind"), F.collect_list(row).alias("events")).write.json(path)
    return K.read_catalog(s, path, "events", "t double, event_id long", "kind string, rec_id long", lines=True)


@query("a01_read_catalog_lines", sql("SELECT rec_id, 'events' AS kind, event_id, t FROM e WHERE event_type <> 'error'", "e"))
def a01_lines(s, d):
    """The same catalogs, laid out a key or a record a line, many to a file: files of their own would be as many as recordings."""
    t = F.when(F.col("event_type") != "error", F.col("t"))
    row = F.to_json(F.struct(t.alias("t"), "event_id", F.col("value").alias("extra")))
    path = K.shared_path(s, "catalogs")
    e = recordings(s, d)
    e.groupBy("rec_id").agg(F.collect_list(row).alias("rows")).select(F.concat(F.lit('{\n  "kind": "events",\n  "rec_id": '), F.coalesce(F.col("rec_id").cast("string"), F.lit("null")), F.lit(',\n  "events": [\n    '), F.array_join("rows", ",\n    "), F.lit("\n  ]\n}")).alias("value")).write.text(path)
    return K.read_catalog_lines(s, path, "events", "t double, event_id long", "kind string, rec_id long")


@query("a02_write_catalog", sql("SELECT rec_id, count(*) AS rows, round(sum(value), 6) AS total, max(event_id) AS last, count(*) AS declared FROM e WHERE event_type = 'view' GROUP BY 1", "e"))
def a02(s, d):
    e, path = recordings(s, d), K.shared_path(s, "written")
    for kind in ("view", "click"):
        part = e.where(F.col("event_type") == kind)
        K.write_catalog(part, part.groupBy("rec_id").agg(F.count("*").alias("declared")), path, kind)
    records, headers = K.read_written(s, path, "view")
    got = records.groupBy("rec_id").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 6).alias("total"), F.max("event_id").alias("last"))
    return got.join(headers.select("rec_id", "declared"), "rec_id").select(F.col("rec_id").cast("long").alias("rec_id"), "rows", "total", "last", "declared")


@query("a03_read_typed_catalog", sql("SELECT CASE WHEN event_id % 10 > 0 THEN event_id END AS event_id, CASE WHEN event_id % 10 > 2 THEN value END AS delta, event_id % 10 = 0 AS refused FROM e", "e"))
def a03(s, d):
    """Every tenth line is broken, two of ten have no reading."""
    e = recordings(s, d).withColumn("reading", F.when(F.col("event_id") % 10 > 2, F.struct(F.col("value").alias("delta"))))
    line = F.to_json(F.struct("event_id", "t", "reading"))
    path = K.shared_path(s, "typed")
    e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("<"), line)).otherwise(line).alias("value")).write.text(path)
    rows = K.read_typed_catalog(s, path, "event_id long, t double, reading struct<delta: double>")
    return rows.select("event_id", "reading.delta", F.col("_corrupt_record").isNotNull().alias("refused"))


_FILES = "f AS (SELECT c_nationkey AS nation, (CASE WHEN c_nationkey % 4 = 0 THEN 'no json: ' ELSE '' END) || '[' || string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) || ']' || chr(10) AS body FROM customer GROUP BY 1)"


def _files(s, d) -> str:
    """One file a nation, with the list of its customers."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")
    body = F.concat(F.when(F.col("c_nationkey") % 4 == 0, "no json: ").otherwise(""), F.lit("["), ids, F.lit("]"))
    path = K.shared_path(s, "documents")
    read(s, d, "customer").groupBy("c_nationkey").agg(body.alias("value")).write.partitionBy("c_nationkey").text(path)
    return f"{path}/*/*.txt"


def _nation():
    return F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("nation")


@query("a04_read_documents", f"WITH {_FILES} SELECT nation, sha256(body) AS sha256, body AS text, nation % 4 <> 0 AS parsed FROM f")
def a04(s, d):
    return K.read_documents(s, _files(s, d)).select(_nation(), "sha256", "text", "parsed")


@query("a05_file_identity", f"WITH {_FILES} SELECT nation, strlen(body)::BIGINT AS size, sha256(body) AS sha256 FROM f")
def a05(s, d):
    files = _files(s, d)
    sizes = K.file_identity(s, files).select("path", "size")
    return sizes.join(K.file_identity(s, files, by_content=True), "path").select(_nation(), "size", "sha256")


@query("a08_preview", sql("SELECT event_id, value, (SELECT count(*) FROM e) > 20 AS truncated FROM e ORDER BY event_id LIMIT 20", "e"))
def a08(s, d):
    """The first rows of the table in its order: the limit is the feature."""
    first, truncated = K.preview(recordings(s, d).select("event_id", "value").orderBy("event_id"), 20)
    return first.withColumn("truncated", F.lit(truncated))
