"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's share of all words is fixed by its weight; a source that can't fill its share within the cap on
repeats gives the excess to the others by weight. A document then has target/size expected copies: the whole
part is certain, the fraction is an inclusion probability. The flight phase moves the probabilities of three
documents at a time along the null space of two constraints (documents, words) until one of them is 0 or 1, so
both totals stay as they are. It runs in hashed buckets of each source; the two documents at most that a bucket
leaves open meet in the next round, until a single bucket per source is left and its landing is solved outright.

Defined results: null or empty text has size 0; a null source is a source of its own, weighed last; a source
without words has target 0; rows that repeat a doc_id are drawn each for itself; the outcome depends on the
rows alone, so reruns agree; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

#: Rows of one bucket: what a task holds at once.
BUCKET_ROWS = 20_000
SALTS = 64


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, sid, n_docs, source_size, target. Sources by code point, null last, weigh `weights`, repeating. The
    one-partition windows are over sources, not documents."""
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    per = per.select("*", F.row_number().over(everything).alias("sid")).withColumn("w", w)
    by_cap = Window.orderBy((cap * F.col("source_size") / F.col("w")), "sid")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    first = F.first(F.when(F.col("level") <= cap * F.col("source_size") / F.col("w"), F.col("level")), ignorenulls=True).over(every)
    target = F.least(cap * F.col("source_size"), F.coalesce(first, F.lit(0.0)) * F.col("w"))
    return per.select("source", "sid", "n_docs", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p to 0 or 1 but for two at most, keeping sum(p) and sum(p * size)."""
    p, size = p.tolist(), size.tolist()
    active: list[int] = []
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    for k, x in enumerate(p):
        if not 1e-9 < x < 1 - 1e-9:
            p[k] = float(round(x))
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, v in zip(active, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            p[i] += step * v
            if not 1e-9 < p[i] < 1 - 1e-9:
                p[i] = float(round(p[i]))
        active = [i for i in active if 0 < p[i] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Close the two open ones at most: the outcome nearest to the words they stand for, then to the documents."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        outcomes = [[(m >> k) & 1 for k in range(len(left))] for m in range(1 << len(left))]
        want, n = float((p[left] * size[left]).sum()), float(p[left].sum())
        p[left] = min(outcomes, key=lambda o: (abs(float(np.dot(o, size[left])) - want), abs(sum(o) - n), o))
    return p


def _fly(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pick", "doc_id", "size"], kind="stable").reset_index(drop=True)
        seed = zlib.crc32(f"{group.sid[0]}:{group.bucket[0]}:{len(group)}".encode())
        p = flight(group.p.to_numpy(float), group["size"].to_numpy(float), np.random.default_rng(seed))
        group["p"] = landing(p, group["size"].to_numpy(float)) if last else p
        return group

    return run


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document; and the columns `carry`."""
    sized = saved(docs.select(*carry, "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("pick")), "sized")
    sources = saved(source_targets(sized, weights, cap), "sources")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "s")
    rows = sized.withColumn("salt", F.pmod(F.shiftrightunsigned("pick", 40), F.lit(SALTS)).cast("int"))
    rows = rows.join(salted, F.col("source").eqNullSafe(F.col("s")) & (rows.salt == salted.salt)).drop("s", "salt")
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    whole = F.floor(expected)
    n_buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    rows = rows.select(*carry, "doc_id", "source", "size", "source_size", "target", "sid", "pick", whole.cast("int").alias("whole"), (expected - whole).alias("p"), F.pmod("pick", n_buckets).alias("bucket"))
    most = sources.agg(F.max(n_buckets)).first()[0] or 1
    done, open_rows = None, rows
    while True:
        flown = open_rows.groupBy("sid", "bucket").applyInPandas(_fly(most == 1), rows.schema)
        if most == 1:
            flown = flown if done is None else done.unionByName(flown)
            return flown.select(*carry, "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("int")).alias("copies"))
        flown = saved(flown, "flown")
        closed = flown.where("p = 0 or p = 1")
        done = closed if done is None else done.unionByName(closed)
        open_rows = flown.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / (BUCKET_ROWS // 2)))
        most = -(-most // (BUCKET_ROWS // 2))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
