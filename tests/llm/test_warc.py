import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chronoframe.llm.entries import ORACLES, QUERIES
from chronoframe.llm.warc import read_warc, write_warc
from tests.oracle import assert_matches

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9999>\r\nContent-Length: 7\r\n\r\nabc\r\n\r\nmore"


@pytest.mark.parametrize("split", [150, 1 << 24])
def test_round_trip_with_magic_inside_payloads(spark, tmp_path, split):
    htmls = [None, "", "plain", "x\r\n", "\r\n\r\n", "a\r\n\r\nb\r\n\r\n", FAKE, "lead\r\n" + FAKE + "\r\n\r\n", "é" * 900, "é" * 900, "é" * 900, "y" * 999, "y" * 999, "\r\n\r\n\r\n", "\n\r\n\r", (FAKE + "z" * 700) * 3]
    rows = [(i, None if i == 3 else f"http://x/{i}\r\nq", h, "junk") for i, h in enumerate(htmls)]
    path = str(tmp_path / "w")
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, path string").coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {int(re.search(r"\d+", r.record_id)[0]): r for r in read_warc(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == list(range(len(htmls)))
    for i, h in enumerate(htmls):
        data = (h or "").encode()
        r = got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        if i in (8, 9):
            assert (r.record_type, r.refers_to) == ("revisit", "<urn:page:10>")
        else:
            assert r.record_type == "response" and bytes(r.body) == data and r.body_sha1 == r.payload_digest
        assert r.target_uri == (None if i == 3 else f"http://x/{i}%0D%0Aq")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_warc(spark, path).agg(F.count("*")).first()[0] == 0


def test_sql(spark, sf_dir):
    assert_matches(spark, sf_dir, QUERIES["op9_warc"], ORACLES["op9_warc"])
