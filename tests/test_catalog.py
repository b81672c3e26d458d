"""Catalogs as files: empty ones are errors with and without a header, one of many lines is read by many tasks."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from chronoframe.operators.udf import mergeable_aggregate, rows_in_order
from chronoframe.sources.catalog import read_catalog, read_catalog_lines


@pytest.mark.parametrize("header", ["", "clip string, fps double"])
@pytest.mark.parametrize("read", [read_catalog, read_catalog_lines])
def test_empty_catalogs(spark, tmp_path, header, read):
    good = {"clip": "a, b: [c]", "fps": 25.0, "hits": [{"t": 2.0, "x": "}"}, {"t": None, "x": "no"}, {"t": 1.0, "x": "{[,"}]}
    one, two, three = (tmp_path / n for n in ("one", "two", "three"))
    for folder, docs in ((one, [good]), (two, [good, {"clip": "e", "fps": 1.0, "hits": []}]), (three, [{"clip": "z", "fps": None, "hits": [{"t": None, "x": "q"}]}])):
        folder.mkdir()
        for k, doc in enumerate(docs):
            records = ",\n    ".join(json.dumps(r) for r in doc["hits"])
            rest = "".join(f"  {json.dumps(k)}: {json.dumps(v)},\n" for k, v in doc.items() if k != "hits")
            (folder / f"{k}.json").write_text("{\n" + rest + f'  "hits": [\n    {records}\n  ]\n}}\n')
    schema = "t double, x string"
    want = [*(("a, b: [c]", 25.0) if header else ()), 1.0, "{[,"]
    got = sorted(read(spark, str(one), "hits", schema, header).collect(), key=lambda r: r.t)
    assert len(got) == 2 and list(got[0]) == want
    for folder in (two, three):
        with pytest.raises(Exception, match="no usable row in hits"):
            read(spark, str(folder), "hits", schema, header).collect()
        assert read(spark, str(folder), "hits", schema, header, allow_empty=True).count() == (2 if folder == two else 0)
    if read is read_catalog_lines:
        with pytest.raises(Exception, match="no usable row in other"):
            read(spark, str(one), "other", schema, header).collect()


def test_a_large_catalog_is_read_by_many_tasks(spark, tmp_path):
    rows = ",\n".join(json.dumps({"t": i * 0.5, "x": "y" * 50}) for i in range(60_000))
    (tmp_path / "c.json").write_text('{\n"clip": "big",\n"hits": [\n' + rows + "\n]\n}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        df = read_catalog_lines(spark, str(tmp_path), "hits", "t double, x string", "clip string")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert df.agg(F.count("*"), F.max("t"), F.min("clip")).first()[:] == (60_000, 29_999.5, "big")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mergeable_aggregate_spreads_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 == 0, "cold").alias("k"), F.col("id").cast("double").alias("v")).repartition(6)
    agg = mergeable_aggregate(df, ["k"], ["v"], lambda: (0, 0.0, 0), lambda s, rows: (s[0] + len(rows), s[1] + float(rows["v"].sum()), max(s[2], s[0] + len(rows))), lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])), lambda s: s, "n long, total double, largest long")
    got = {r.k: (r.n, r.total, r.largest) for r in agg.collect()}
    assert {k: v[:2] for k, v in got.items()} == {"hot": (18_000, 180_000_000.0), "cold": (1000, 9_990_000.0), None: (1000, 10_000_000.0)}
    assert got["hot"][2] < 18_000 / 3  # no task has seen the whole key
    assert mergeable_aggregate(df.where("false"), ["k"], ["v"], lambda: 0, lambda s, r: s, lambda a, b: a, lambda s: (s,), "n long").collect() == []


def test_rows_in_order_by_analyze(spark):
    class Gaps:
        def __init__(self):
            self.last = None

        def feed(self, row):
            if self.last is not None and row["t"] - self.last > 1:
                yield row["k"], self.last, row["t"]
            self.last = row["t"]

        def end(self):
            yield None, self.last, None

    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 2.0), ("b", 0.0)], "k string, t double").repartition(3)
    got = rows_in_order(df, ["k"], ["t"], Gaps, lambda of: StructType([of["k"], StructField("low", of["t"].dataType), StructField("high", of["t"].dataType)]))
    assert got.schema.simpleString() == "struct<k:string,low:double,high:double>"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 2.0, 5.0), (None, 5.0, None), (None, 0.0, None)], key=repr)


@pytest.mark.parametrize("part", ["120", "1000000"])
def test_many_catalogs_in_one_file(spark, tmp_path, part):
    """Each record keeps the header of its own catalog, wherever the file is cut; one without a record is still an error."""
    one = lambda k, n: f'{{\n  "kind": "k{k}",\n  "rec_id": {k},\n  "hits": [\n    ' + ",\n    ".join(json.dumps({"t": i + k / 100}) for i in range(n)) + "\n  ]\n}\n"
    (tmp_path / "a").mkdir()
    for f, ks in enumerate(([0, 1, 2, 3], [4], [5, 6])):
        (tmp_path / "a" / f"{f}.json").write_text("".join(one(k, 3 + 7 * k) for k in ks))
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = lambda **more: read_catalog_lines(spark, str(tmp_path / "a"), "hits", "t double", "kind string, rec_id long", **more)
        want = sorted((f"k{k}", k, i + k / 100) for k in range(7) for i in range(3 + 7 * k))
        assert sorted(map(tuple, read().collect())) == want
        (tmp_path / "a" / "3.json").write_text(one(8, 2) + one(9, 0) + one(7, 1))
        with pytest.raises(Exception, match="no usable row in hits"):
            read().collect()
        assert sorted(map(tuple, read(allow_empty=True).collect())) == sorted([*want, ("k7", 7, 0.07), ("k8", 8, 0.08), ("k8", 8, 1.08)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
