"""Structured Streaming forms of the operators that look ahead only. Times are timestamps with time zone."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def stream_levels(stream: DataFrame, by: list[str], col: str, width: str, hop: str, late: str) -> DataFrame:
    """Mean square per window; whole windows only, as the watermark passes."""
    w = stream.withWatermark("ts", late).groupBy(*by, F.window("ts", width, hop).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg(F.col(col) * F.col(col)).alias("mean_square")).select(*by, F.col("w.start").alias("start"), "n", "mean_square")


def stream_bursts(stream: DataFrame, by: list[str], level: str, threshold: float, gap: str, late: str) -> DataFrame:
    """Rows over the threshold joined while no gap is as long as `gap` (pass the merge gap and one step)."""
    over = stream.where(F.col(level) >= threshold).withWatermark("ts", late)
    s = over.groupBy(*by, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("rows"), F.max(level).alias("peak"))
    return s.select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "rows", "peak")


def stream_enrich(stream: DataFrame, catalog: DataFrame, by: list[str], width: str = "1 day") -> DataFrame:
    """Rows with the span (start, stop) of a static catalog that holds them. Both meet on buckets of `width` in time, so a row
    meets the spans of its time only, not all of its key; open spans are dealt up to the bucket after the last that closes."""
    step = F.lit(pd.Timedelta(width).value // 1000)
    bucket = lambda c: F.floor(F.unix_micros(c) / step)
    ends = catalog.agg(F.max(bucket(F.col("start"))).alias("_top"))  # one row
    spans = catalog.select(*(F.col(c).alias(f"_s_{c}") if c in by else F.col(c) for c in catalog.columns)).join(F.broadcast(ends))
    first, last = bucket(F.col("start")), F.greatest(F.least(bucket(F.col("stop")), F.col("_top") + 1), bucket(F.col("start")))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(first, last))).drop("_top")
    # rows after all starts meet what is open then in one bucket
    rows = stream.join(F.broadcast(ends)).withColumn("_at", F.least(bucket(F.col("ts")), F.col("_top") + 1)).drop("_top")
    inside = (rows["_at"] == spans["_bucket"]) & (rows["ts"] >= spans["start"]) & (rows["ts"] < spans["stop"])
    for c in by:
        inside &= rows[c] == spans[f"_s_{c}"]
    return rows.join(spans, inside, "left").drop("_at", "_bucket", *(f"_s_{c}" for c in by))


def stream_dedupe(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class _InOrder(StatefulProcessor):
    """Rows wait until the watermark has passed them, then go through `machine`, key by key, in order of time. Rows that come
    after the watermark are dropped. Keys share their state by buckets, so that calls of the state store are as many as buckets
    of a batch, not as keys. State: the rows that wait, those of a batch packed into one value, and what the machine keeps of
    each key."""

    def __init__(self, machine, columns: list[str]):
        self.machine, self.columns = machine, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")
        self.kept = handle.getListState("kept", "k string, x long")

    def _due(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for f in rows:
            f = f[f["us"] > mark]
            if len(f):
                self.rows.appendValue((pickle.dumps(list(zip(f["k"], f["us"].tolist(), f["v"].tolist()))),))
                self._due(int(f["us"].min()))
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        states = dict(self.kept.get()) if self.kept.exists() else {}
        ready, rest = {k: [] for k in states}, []
        for (packed,) in self.rows.get() if self.rows.exists() else ():
            for k, us, v in pickle.loads(packed):
                if us <= mark:
                    ready.setdefault(k, []).append((us, v))
                else:
                    rest.append((k, us, v))
        found, kept, wake = [], [], [us for _, us, _ in rest]
        for k, held in ready.items():
            out, state, due = self.machine(states.get(k), sorted(held), mark)
            found.extend((k, *r) for r in out)
            if state is not None:
                kept.append((k, state))
                wake += [] if due is None else [due]
        for held, state in ((rest and [(pickle.dumps(rest),)], self.rows), (kept, self.kept)):
            if held:
                state.put(held)
            else:
                state.clear()
        if wake:
            self._due(min(wake))
        yield pd.DataFrame(found, columns=self.columns)

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, by: str, value: Column, late: str, machine, out: str, buckets: int = 4096) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = stream.schema[by].dataType
    rows = stream.withWatermark("ts", late).select(F.pmod(F.xxhash64(by), F.lit(buckets)).alias("bucket"), F.col(by).cast("string").alias("k"), "ts", F.unix_micros("ts").alias("us"), value.cast("double").alias("v")).where("us is not null and v is not null")
    columns = ["k", *(x.split()[0] for x in out.split(", "))]
    found = rows.groupBy("bucket").transformWithStateInPandas(_InOrder(machine, columns), f"k string, {out}", "append", "eventTime")
    return found.select(F.col("k").cast(kind).alias(by), F.timestamp_micros("us").alias("ts"), *columns[2:])


def stream_state(stream: DataFrame, by: str, level: str, opens: float, closes: float, late: str = "1 hour", idle: str | None = None) -> DataFrame:
    """Changes of the hysteresis gate per key: on at or over `opens`, off under `closes`. Rows up to `late` behind are put in
    order, later ones dropped. Only open gates keep state; with `idle`, a gate without rows for so long closes then."""
    wait = None if idle is None else pd.Timedelta(idle).value // 1000

    def gate(last, rows, mark):  # last: the last row of an open gate
        found = []
        for us, v in rows:
            if last is not None and wait is not None and us - last >= wait:
                found.append((last + wait, False))
                last = None
            if last is None and v >= opens:
                found.append((us, True))
                last = us
            elif last is not None and v < closes:
                found.append((us, False))
                last = None
            elif last is not None:
                last = us
        if last is not None and wait is not None and last + wait <= mark:
            found.append((last + wait, False))
            last = None
        return found, last, None if last is None or wait is None else last + wait

    return _in_order(stream, by, F.col(level), late, gate, "us long, open boolean")


def stream_thin(stream: DataFrame, by: str, gap: float, late: str = "1 hour") -> DataFrame:
    """Greedy thinning in order of time: rows up to `late` behind are put in order, later ones dropped. The last kept time is
    forgotten once the watermark is a gap beyond it, as every row to come is then free."""
    far = round(gap * 1_000_000)

    def thinned(last, rows, mark):
        found = []
        for us, _ in rows:
            if last is None or us - last >= far:
                found.append((us,))
                last = us
        return found, None if last is None or last + far <= mark else last, None if last is None else last + far

    return _in_order(stream, by, F.lit(0.0), late, thinned, "us long")
