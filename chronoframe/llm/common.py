"""Helpers shared by the corpus operators: table access, written tables and rolling hashes."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space that bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(29)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a temporary one, but only in local mode: a
    cluster's executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The written tables of each open temporary().
_TEMPORARY: list[list[str]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    for paths in _TEMPORARY:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_place(docs: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """docs, and for each row a hash of its file and its place in it, which tells equal rows apart and is the same whenever
    docs is read again; docs that are no written table are written first."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place).schema  # noqa: B018
    except AnalysisException:
        docs = saved(docs, name)
        place = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(place["file_path"], place["row_index"])


def delete(spark: SparkSession, *paths: str) -> None:
    """Written tables that are no longer needed."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that saved() writes inside are deleted at the end. Gives a saved() whose tables stay: what is made of the
    others is to be written by it."""
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = saved(df, name)
        paths.pop()
        return out

    _TEMPORARY.append(paths)
    try:
        yield kept
    finally:
        _TEMPORARY.remove(paths)
        delete(spark, *paths)


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    a = (a ^ (a >> _SHIFT)) * _MUL
    return (a ^ (a >> _SHIFT)) * _MUL2


#: Odd multipliers of the bytes, and of their places, in the hash of a word; bytes that part words; bytes hashed at once.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_PLACE, _PLACE_INVERSE = np.uint64(_P := 0x9E3779B97F4A7C15), np.uint64(pow(_P, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SLAB = 1 << 21


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.full(_SLAB + 2, p)) for p in (_PLACE, _PLACE_INVERSE))


def _slab_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of data, which ends in white space."""
    b = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True))
    start, end = edge[::2], edge[1::2]
    powers, inverse = _powers()
    total = np.append(np.uint64(0), np.cumsum(_BYTE[b] * powers[: len(b)]))
    return start, mix((total[end] - total[start]) * inverse[start])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each: a polynomial of a word's bytes, scrambled."""
    hashes, counts, run, size = [np.zeros(0, np.uint64)], [], [], 0

    def close():
        nonlocal size
        if run:
            start, h = _slab_hashes(b"".join(run))
            hashes.append(h)
            counts.append(np.diff(np.searchsorted(start, np.cumsum([0, *map(len, run)]))))
            run.clear()
            size = 0

    for t in texts:
        if len(t) > _SLAB:  # by itself, in pieces of whole words
            close()
            words, part = t.split(), []
            for w in words:
                if size + len(w) >= _SLAB:
                    hashes.append(_slab_hashes(b" ".join([*part, b""]))[1])
                    part, size = [], 0
                if len(w) > _SLAB:
                    hashes.append(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64))
                else:
                    part.append(w)
                    size += len(w) + 1
            hashes.append(_slab_hashes(b" ".join([*part, b""]))[1])
            counts.append(np.array([len(words)]))
            size = 0
            continue
        if size + len(t) >= _SLAB:
            close()
        run.append(t + b" ")
        size += len(t) + 1
    close()
    return np.concatenate(hashes), np.concatenate([*counts, np.zeros(0, np.int64)])


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values, built by doubling; empty if there are fewer than n."""
    if len(h) < n:
        return h[:0]
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            m = len(h) - have - size + 1
            out = power[:m] if out is None else mix(out[:m] * _MUL + power[have : have + m])
            have += size
        if size * 2 > n:
            return out
        power = mix(power[:-size] * _MUL + power[size:])
        size *= 2


def rolling_min(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    if len(h) < n:
        return h[:0]
    low, size = h, 1
    while size * 2 <= n:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    m = len(h) - n + 1
    return np.minimum(low[:m], low[n - size : n - size + m])


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def text_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, texts) for runs of rows of about CHUNK_BYTES."""
    first, texts, n = 0, [], 0
    for i, text in enumerate(as_bytes(batch.column(column))):
        texts.append(text)
        n += len(text)
        if n >= CHUNK_BYTES:
            yield first, texts
            first, texts, n = i + 1, [], 0
    if texts:
        yield first, texts


def sliced(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)
