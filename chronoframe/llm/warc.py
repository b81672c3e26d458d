"""WARC writing, and reading by boundary-chain verification.

Archives are written by Spark's text sink, a record per row. They are read in splits of any size: the text
source cuts each file at every blank line (CRLF CRLF), so the block of header lines of a record is one row.
Tasks emit each magic they see, in headers or inside payloads, as a candidate with the offset of its successor
(its own end by Content-Length). Inside a split the chain is followed in the task; between splits, pointer
jumping from the start of each file doubles the reach in every round. Only candidates reached that way are
records, so a magic inside a payload is rejected.

Defined results: null payloads are empty; a null url has no WARC-Target-URI and reads back as null; a null
page_id reads back as null; CR and LF in a url are percent-encoded; rows that repeat a page_id with the same
payload are each written, and if that page is the response of its group all of them are responses; extra
columns are ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, saved, table

EOL, GAP = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = re.compile(rb"(?:\A|\r\n)(WARC/1\.[01]\r\n)")
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$", re.M)
_FOUND = "path string, block long, total long, rel long, rel_next long, rel_exit long, n_header long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, stated long, n_body long, body_sha1 string, body binary"


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to: the largest page_id with an equal payload of min_bytes or more, null for that page itself and for single or smaller payloads."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    pages = pages.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest"))
    digests = saved(pages.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest"), "digests")
    keepers = digests.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    # written, so that Spark knows its size: pages are shuffled only where the revisits are too many to broadcast
    refs = saved(digests.join(keepers, "payload_digest").where("page_id < refers_to").distinct(), "revisits")
    return pages.join(refs, ["page_id", "payload_digest"], "left")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Write each page as a response or revisit record into the archives under path."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    p = with_revisits(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    record = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{EOL}"),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("refers_to")))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
        F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit(GAP)),
        http,
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    p.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _fields(header: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v for k, v in reversed(_FIELD.findall(header))}


def _named(header: bytes) -> dict:
    f, text = _fields(header), lambda v: v.decode("utf-8", "replace") or None
    named = {c: text(f.get(n, b"")) for c, n in (("record_type", b"warc-type"), ("record_id", b"warc-record-id"), ("target_uri", b"warc-target-uri"), ("refers_to", b"warc-refers-to"))}
    return named | {"n_header": len(header), "payload_digest": text(f.get(b"warc-payload-digest", b"").removeprefix(b"sha1:"))}


def _stated(http: bytes) -> int | None:
    """The full length of the payload, as the HTTP header says it."""
    length = _fields(http).get(b"content-length", b"")
    return int(length) if length.isdigit() else None


class _Candidate:
    __slots__ = ("rel", "next", "header", "need", "parts", "have")

    def __init__(self, rel: int, header: bytes, start: int, length: int):
        self.rel, self.header, self.need, self.next, self.parts, self.have = rel, header, length, start + length + 4, [], 0


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", GAP).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))


def _scan(keep_body: bool):
    """Candidates of every split, each with its successor and where its chain leaves the split, and a row with the split's size."""

    def rows(path: str, block: int, total: int, found: list[_Candidate]) -> Iterator[dict]:
        exits: dict[int, int] = {}
        for c in sorted(found, key=lambda c: -c.rel):
            exits[c.rel] = c.next if c.next >= total else exits.get(c.next, -1)
        yield {"path": path, "block": block, "total": total}
        for c in found:
            row = {"path": path, "block": block, "rel": c.rel, "rel_next": c.next, "rel_exit": exits[c.rel]} | _named(c.header)
            if c.have >= c.need:
                http, _, body = b"".join(c.parts)[: c.need].partition(b"\r\n\r\n")
                row |= {"stated": _stated(http), "n_body": len(body), "body_sha1": hashlib.sha1(body).hexdigest(), "body": body if keep_body else None}
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("block", "total", "rel", "rel_next", "rel_exit")), ("n_header", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")), ("stated", pa.int64()), ("n_body", pa.int64()), ("body_sha1", pa.string()), ("body", pa.binary())])
        split, at, found, waiting = None, 0, [], []
        for batch in batches:
            for path, block, chunk in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "chunk")), strict=True):
                if (path, block) != split:
                    if split:
                        yield pa.RecordBatch.from_pylist(list(rows(*split, at, found)), schema)
                    split, at, found, waiting = (path, block), 0, [], []
                for c in waiting:
                    c.parts += (chunk, b"\r\n\r\n")
                    c.have += len(chunk) + 4
                waiting = [c for c in waiting if c.have < c.need]
                for m in _MAGIC.finditer(chunk):
                    header = chunk[m.start(1) :]
                    length = _fields(header).get(b"content-length", b"")
                    if length.isdigit():
                        found.append(_Candidate(at + m.start(1), header, at + len(chunk) + 4, int(length)))
                        waiting += found[-1:] if found[-1].need else []
                at += len(chunk) + 4
        if split:
            yield pa.RecordBatch.from_pylist(list(rows(*split, at, found)), schema)

    return run


def _reached(found: DataFrame, splits: DataFrame) -> DataFrame:
    """path, at: the offsets at which the chain of each file, from its start, enters a split."""
    spark = found.sparkSession
    starts = found.join(splits, ["path", "block"]).select("path", (F.col("base") + F.col("rel")).alias("at"), F.when(F.col("rel_exit") >= 0, F.col("base") + F.col("rel_exit")).alias("to"))
    entries = starts.select("path", F.col("to").alias("at")).where("at is not null").union(splits.select("path", F.lit(0).cast("long"))).distinct()
    jumps = saved(starts.join(entries, ["path", "at"]), "jumps")
    reach = splits.select("path", F.lit(0).cast("long").alias("at")).distinct()
    most = splits.groupBy("path").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(0, int(most - 1)).bit_length()):
        more = reach.join(jumps, ["path", "at"]).where("to is not null").select("path", F.col("to").alias("at"))
        reach = saved(reach.union(more).distinct(), "reach")
        second = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = saved(jumps.join(second, ["path", "to"]).select("path", "at", F.col("beyond").alias("to")), "jumps")
    return reach


def _walk(group: pa.Table) -> pa.Table:
    """The candidates of one split that its entry reaches."""
    at = {r: i for i, r in enumerate(group.column("rel").to_pylist())}
    follow, now, keep = group.column("rel_next").to_pylist(), group.column("entry")[0].as_py(), []
    while now in at:
        keep.append(at[now])
        now = follow[at[now]]
    return group.take(pa.array(keep, pa.int64()))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """path, offset, record_type, record_id, target_uri, refers_to, payload_digest (as the header states it), payload_bytes (full length), body_sha1 and, with payload, body."""
    lines = _lines(spark, path)
    scanned = saved(lines.mapInArrow(_scan(False), _FOUND).drop("body"), "candidates")
    order = Window.partitionBy("path").orderBy("block")
    splits = saved(scanned.where("total is not null").select("path", "block", "total", (F.sum("total").over(order) - F.col("total")).alias("base")), "splits")
    found = scanned.where("total is null").drop("total")
    entered = _reached(found, splits).join(splits, "path").where("at >= base and at < base + total").select("path", "block", "base", (F.col("at") - F.col("base")).alias("entry"))
    kept = found.join(entered, ["path", "block"])
    kept = kept.groupBy("path", "block").applyInArrow(_walk, kept.schema)
    cut = kept.where("n_body is null and rel_next > rel + n_header + 8")
    if payload:
        bodies = lines.mapInArrow(_scan(True), _FOUND).where("body is not null").select("path", "block", "rel", "body")
        kept = kept.join(bodies, ["path", "block", "rel"], "left")
    kept = _complete(kept, cut, lines, splits, payload)
    return kept.select(
        "path",
        (F.col("base") + F.col("rel")).alias("offset"),
        "record_type",
        "record_id",
        "target_uri",
        "refers_to",
        "payload_digest",
        F.coalesce("stated", "n_body").alias("payload_bytes"),
        "body_sha1",
        *(["body"] if payload else []),
    )


def _complete(kept: DataFrame, cut: DataFrame, lines: DataFrame, splits: DataFrame, payload: bool) -> DataFrame:
    """Give records whose content runs over the end of their split the rest of it from the splits that follow."""
    keys = ["path", "block", "rel"]
    start, end = F.col("base") + F.col("rel") + F.col("n_header") + 4, F.col("base") + F.col("rel_next") - 4
    wanted = cut.select(*keys, start.alias("from"), end.alias("until"))
    held = splits.select("path", F.col("block").alias("b"), F.col("base").alias("b0"), (F.col("base") + F.col("total")).alias("b1"))
    # a record per split at most; written first, so that its size is known where the chunks are joined with it
    parts = saved(wanted.join(held, "path").where("b0 < until and b1 > from"), "parts")
    if parts.isEmpty():
        return kept

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            rel = []
            for path, block, n in zip(batch.column("path").to_pylist(), batch.column("b").to_pylist(), (len(c) for c in batch.column("chunk").to_pylist()), strict=True):
                if (path, block) != split:
                    split, at = (path, block), 0
                rel.append(at)
                at += n + 4
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel, pa.int64())], names=[*batch.schema.names, "o"])

    chunks = lines.select("path", F.col("block").alias("b"), "chunk").mapInArrow(offsets, "path string, b long, chunk binary, o long")
    inside = chunks.join(parts, ["path", "b"]).withColumn("o", F.col("o") + F.col("b0")).where("o < until and o + length(chunk) + 4 > from")
    whole = inside.groupBy(*keys, "from", "until").agg(F.array_sort(F.collect_list(F.struct("o", "chunk"))).alias("c"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = b"".join(x["chunk"] + b"\r\n\r\n" for x in r["c"])[r["from"] - r["c"][0]["o"] :][: r["until"] - r["from"]]
                http, _, body = data.partition(b"\r\n\r\n")
                out.append({k: r[k] for k in keys} | {"stated2": _stated(http), "n2": len(body), "sha2": hashlib.sha1(body).hexdigest(), "body2": body if payload else None})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("stated2", pa.int64()), ("n2", pa.int64()), ("sha2", pa.string()), ("body2", pa.binary())]))

    rest = whole.mapInArrow(join_up, "path string, block long, rel long, stated2 long, n2 long, sha2 string, body2 binary")
    both = kept.join(rest, keys, "left").withColumns({"stated": F.coalesce("stated", "stated2"), "n_body": F.coalesce("n_body", "n2"), "body_sha1": F.coalesce("body_sha1", "sha2")})
    if payload:
        both = both.withColumn("body", F.coalesce("body", "body2"))
    return both.drop("stated2", "n2", "sha2", "body2")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    r = read_warc(spark, path, payload=False)
    # a response's digest is that of the bytes read; a revisit states its own
    digest = F.when(F.col("record_type") == "response", F.col("body_sha1")).otherwise(F.col("payload_digest"))
    return r.select(page("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN keep > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep > page_id THEN keep END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
