"""Catalogs, documents, file sequences and run records as tables, and their listings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; a temporary one in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read from there: worked out once for all that read it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_catalog(spark: SparkSession, path: str, field: str, schema: str, header: str = "", allow_empty: bool = False, lines: bool = False) -> DataFrame:
    """The records of an array field of JSON catalogs (one a file, or one a line), with the header's columns; rows without a numeric t are dropped. No usable row is an error where the result is read, unless allow_empty."""
    top = ", ".join(x for x in (header, f"{field} array<struct<{schema}>>") if x)
    docs = spark.read.schema(top).json(path, multiLine=not lines)
    names = [c for c in docs.columns if c != field]
    file = docs.metadataColumn("_metadata")["file_path"].alias("_file")
    rows = docs.select(file, *names, F.explode_outer(field).alias("r")).select("_file", *names, "r.*")
    kept = rows.where("t is not null")
    if allow_empty:
        return kept.drop("_file")
    total = F.count("t").over(Window.partitionBy("_file", *names))
    return rows.withColumn("_n", total).where(F.col("t").isNotNull() | F.assert_true(F.col("_n") > 0, F.lit(f"no usable row in {field}")).isNotNull()).drop("_n", "_file")


def read_catalog_lines(spark: SparkSession, path: str, field: str, schema: str, header: str = "", allow_empty: bool = False) -> DataFrame:
    """read_catalog() for catalogs laid out a key or a record a line, one or more a file: files are cut at line ends, so that one
    of any size is read by many tasks and never held whole. In a file of more than one, each starts at a line with nothing but
    an unindented brace. A catalog's header is the scalar keys on lines of their own. A catalog without the field or without a
    record with a numeric t is an error where the result is read, unless allow_empty."""
    raw = spark.read.text(path)
    line = F.regexp_replace(F.trim(F.col("value")), r",\s*$", "")
    # catalogs are numbered from the first brace of their file on: first inside each split, then by the splits before it
    meta = raw.metadataColumn("_metadata")
    lines = raw.select(meta["file_path"].alias("_file"), meta["file_block_start"].alias("_at"), F.monotonically_increasing_id().alias("_i"), F.col("value").rlike(r"^\{\s*$").cast("long").alias("_opens"), line.alias("line"))
    split = Window.partitionBy("_file", "_at").orderBy("_i")
    opened = lines.groupBy("_file", "_at").agg(F.sum("_opens").alias("_opened"))
    before = F.coalesce(F.sum("_opened").over(Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = ["_file", "_no"]
    lines = lines.withColumn("_no", F.sum("_opens").over(split)).join(opened.select("_file", "_at", before.alias("_before")), ["_file", "_at"])
    lines = lines.select("_file", F.greatest(F.col("_no") + F.col("_before"), F.lit(1)).alias("_no"), "line")
    record = F.from_json(F.when(F.col("line").rlike(r"^\{.*\S.*\}$"), F.col("line")), schema)
    records = lines.select(*keys, record.alias("r")).select(*keys, "r.*").where("t is not null")
    names = StructType.fromDDL(header).fields if header else []
    keyed = F.from_json(F.when(F.col("line").rlike(r'^"[^"]+"\s*:\s*("([^"\\]|\\.)*"|[^\[{"]+)$'), F.concat(F.lit("{"), "line", F.lit("}"))), header or "_ string")
    tops = lines.select(*keys, keyed.alias("k"), F.col("line").rlike(rf'^"{field}"\s*:\s*\[').alias("_has"), record["t"].alias("_t"))
    files = tops.groupBy(*keys).agg(F.max("_has").alias("_has"), F.count("_t").alias("_n"), *(F.max(f"k.{f.name}").alias(f.name) for f in names))
    own = [f.name for f in names]
    if allow_empty:
        return files.join(records, keys).drop(*keys, "_has", "_n")
    usable = F.coalesce("_has", F.lit(False)) & (F.col("_n") > 0)
    rows = files.join(records, keys, "left").where(F.when(usable, F.col("t").isNotNull()).otherwise(F.raise_error(F.lit(f"no usable row in {field}")).isNull()))
    return rows.select(*own, *(c for c in records.columns if c not in keys))


def write_catalog(df: DataFrame, header: DataFrame, path: str, kind: str, buckets: int = 16) -> None:
    """Records by kind and bucket of recordings, the header as one row per recording beside them. A recording is in one bucket,
    in order, so that a reader of few recordings skips the rest; the number of files doesn't grow with that of recordings."""
    bucket = F.pmod(F.xxhash64("rec_id"), F.lit(buckets)).alias("bucket")
    for part, rows in (("records", df), ("headers", header)):
        rows = rows.select("*", F.lit(kind).alias("kind"), bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "rec_id")
        rows.write.mode("append").partitionBy("kind", "bucket").parquet(f"{path}/{part}")


def read_written(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    get = lambda part: spark.read.parquet(f"{path}/{part}").where(F.col("kind") == kind).drop("bucket")
    return get("records"), get("headers")


def read_typed_catalog(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by a declared schema; a line that doesn't fit is kept in _corrupt_record, not lost."""
    full = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(StructType([*full.fields]).add("_corrupt_record", "string")).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """path, sha256, text and whether it parses as JSON; a parse error is a row, not an exception."""
    files = spark.read.format("binaryFile").load(glob)
    text = F.decode("content", "UTF-8")
    return files.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"), F.try_parse_json(text).isNotNull().alias("parsed"))


def file_identity(spark: SparkSession, glob: str, by_content: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").load(glob)
    if by_content:
        return files.select("path", F.sha2("content", 256).alias("sha256"))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def memo_key(kind: Column, inputs: Column, params: Column) -> Column:
    """sha256 of canonical JSON of kind, inputs and params; maps are taken in key order."""
    ordered = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), ordered(inputs).alias("inputs"), ordered(params).alias("params"))).cast("binary"), 256)


def pending(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without a finished result whose artifacts still exist."""
    return requests.join(done.where("artifacts_exist").select("key"), "key", "left_anti")


def sequence_run(files: DataFrame, name: str = "path", by: list[str] | None = None) -> DataFrame:
    """Per numbered sequence: stem, first index and length of the unbroken run from it."""
    parts = files.select(*(by or []), F.regexp_extract(name, r"^(.*?)(\d+)(\.\w+)$", 1).alias("stem"), F.regexp_extract(name, r"^(.*?)(\d+)(\.\w+)$", 3).alias("ext"), F.regexp_extract(name, r"(\d+)\.\w+$", 1).try_cast("long").alias("index")).where("index is not null").distinct()
    keys = [*(by or []), "stem", "ext"]
    w = Window.partitionBy(*keys).orderBy("index")
    runs = parts.withColumn("island", F.col("index") - F.row_number().over(w)).withColumn("head", F.first("island").over(w))
    return runs.where("island = head").groupBy(*keys).agg(F.min("index").alias("first"), F.count("*").alias("length"))


def preview(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """The first n rows, and whether there are more; reads n + 1 rows, not all."""
    return df.limit(n), len(df.limit(n + 1).take(n + 1)) > n


def history(runs: DataFrame, state: str | None = None) -> DataFrame:
    """Run records, newest first; an unknown state is refused."""
    if state is not None and state not in ("queued", "running", "done", "failed", "cancelled"):
        raise ValueError(f"unknown state {state!r}")
    return (runs if state is None else runs.where(F.col("state") == state)).orderBy(F.desc("started_at"), F.desc("sequence"))


def list_inventory(df: DataFrame, bin: str | None = None, name_contains: str | None = None, offline_only: bool = False, recursive: bool = True) -> DataFrame:
    """Rows of an inventory (bin, name, offline) under a bin path, with a part of the name, offline or not."""
    if bin is not None:
        df = df.where((F.col("bin") == bin) | F.col("bin").startswith(bin + "/") if recursive else F.col("bin") == bin)
    if name_contains is not None:
        df = df.where(F.lower("name").contains(name_contains.lower()))
    return df.where("offline") if offline_only else df


def inspect_range(items: DataFrame, by: list[str], start: float | None = None, end: float | None = None) -> DataFrame:
    """Per track: count of items and of those that touch [start, end); items of unknown position count."""
    if start is not None and end is not None and end < start:
        raise ValueError("end before start")
    hit = F.col("first").isNull() | F.col("last").isNull()
    inside = F.lit(True)
    if end is not None:
        inside &= F.col("first") < end
    if start is not None:
        inside &= F.col("last") > start
    return items.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(hit | inside).alias("touching"))


def span_filter(df: DataFrame, start: float | None = None, end: float | None = None, t: str = "t") -> DataFrame:
    """Rows with start <= t < end, either edge optional."""
    if start is not None and end is not None and end < start:
        raise ValueError("end before start")
    if start is not None:
        df = df.where(F.col(t) >= start)
    return df if end is None else df.where(F.col(t) < end)
