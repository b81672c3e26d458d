"""Sections of a recording: the stretches between bursts of a curve, from where the sound comes up (I4), and how many
settings find a known truth (I20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import islands as I
from ..operators import joins as J
from ..operators import windows as W
from ..sources.catalog import written


def reading(curve: DataFrame, by: list[str], level: str, ceiling: float, scale: Column, burst: float, quiet: float = 10.0, floor: float = 0.02, quiet_burst: float = 2.0) -> DataFrame:
    """threshold and shortest burst per key: the ceiling where `quiet` seconds reach it, or for a single row; else a share of
    the level held as long as a burst, between floor and ceiling, with shorter bursts."""
    least = min(burst, quiet_burst)
    c = A.with_step(curve, by)
    over = c.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(level) >= ceiling, F.col("step"))), F.lit(0.0)).alias("_over"), F.count("*").alias("_n"))
    r = over.join(A.held_level(c, by, level, "step", least), by)
    kept = (scale <= 0) | (F.col("_n") < 2) | (F.col("_over") >= quiet)
    own = F.least(F.lit(ceiling), F.greatest(F.lit(floor), F.col("held") * scale))
    return r.select(*by, F.when(kept, F.lit(ceiling)).otherwise(own).alias("threshold"), F.when(kept, F.lit(burst)).otherwise(least).alias("burst"))


def calls(curve: DataFrame, by: list[str], level: str, read: DataFrame, gap: float, minimum: float) -> DataFrame:
    """The stretches between bursts, of `minimum` seconds at least: start, stop, and the seconds of the burst on each side. A
    recording without bursts is one call. read: threshold and burst per key."""
    c = curve.join(read, by)
    spans = I.merge_gaps(I.runs(c, by, F.col(level) >= F.col("threshold"), level), by, gap)
    spans = spans.join(read, by).where(F.col("stop") - F.col("start") >= F.col("burst")).select(*by, "start", "stop")
    totals = curve.groupBy(*by).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    found = I.complement(spans, totals, by, 0.0)
    none = totals.join(spans.select(*by).distinct(), by, "left_anti").select(*by, F.col("first").alias("start"), F.col("last").alias("stop"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"))
    found = found.unionByName(none).withColumns({"start": F.round("start", 3), "stop": F.round("stop", 3)})
    return found.where(F.col("stop") - F.col("start") >= minimum)


def settle(found: DataFrame, loudness: DataFrame, by: list[str], margin: Column, hold: Column, minimum: float) -> DataFrame:
    """Each call with talk_seconds and outcome: its start moves to the first row that is over the median less margin and stays
    there for the hold. silent: it never comes up; brief: too little is left; null: kept, talk_seconds null where the levels
    can't say (unknown is not zero). loudness: t and level, by the same keys; margin and hold may be columns of `found`."""
    usual = loudness.groupBy(*by).agg(F.percentile("level", F.lit(0.5)).alias("_usual"))
    f = found.join(usual, by, "left").withColumns({"_floor": F.col("_usual") - margin, "_hold": hold})
    inside = J.point_in_interval(loudness.select(*by, "t", "level"), f, by, ["start", "_floor", "_hold"]).where("r_start is not null")
    inside = inside.withColumnsRenamed({"r_start": "start"})
    came = W.first_sustained(inside, [*by, "start"], "level", F.col("r__floor"), F.col("r__hold")).withColumnRenamed("t", "_came")
    f = f.join(came, [*by, "start"], "left")
    unknown = ~F.coalesce("measured", F.lit(False)) | (F.col("_hold") <= 0)
    moved = F.when(~unknown & F.col("_came").isNotNull(), F.round("_came", 3))
    outcome = F.when(unknown, None).when(F.col("_came").isNull(), "silent").when(F.col("stop") - moved < minimum, "brief")
    f = f.withColumns({"talk_seconds": F.round(F.round("_came", 3) - F.col("start"), 3), "outcome": outcome, "_moved": F.coalesce(moved, "start")})
    return f.withColumn("talk_seconds", F.when(~unknown, F.col("talk_seconds"))).withColumn("start", F.col("_moved")).select(*found.columns, "talk_seconds", "outcome")


def sifted(settled: DataFrame, beats: DataFrame | None, by: list[str], density: float, places: int = 3) -> DataFrame:
    """Beats and beats per second of each call; kept ones with less than `density` are sparse. Without beats none is."""
    if beats is None:
        return settled.withColumns({"beats": F.lit(None).cast("long"), "rate": F.lit(None).cast("double")})
    s = settled.withColumn("_id", F.struct("start", "stop"))
    d = J.count_in(s, beats, by, "_id")
    d = d.withColumns({"beats": F.col("n").cast("long"), "rate": F.round("density", places)})
    return d.withColumn("outcome", F.when(F.col("outcome").isNull() & (F.col("rate") < density), "sparse").otherwise(F.col("outcome"))).drop("_id", "n", "density")


def sections(curve: DataFrame, loudness: DataFrame, beats: DataFrame | None, by: list[str], level: str, ceiling: float = 0.5, scale: float = 0.09, gap: float = 2.0, burst: float = 5.0, minimum: float = 60.0, margin: float = 6.0, hold: float = 10.0, density: float = 0.5, quiet: float = 10.0, floor: float = 0.02, quiet_burst: float = 2.0, places: int = 3) -> DataFrame:
    """One row per call: start, stop, before, after, talk_seconds, outcome (null: a section; silent, brief or sparse), beats,
    rate. loudness: t and level. Each step is written to the shared folder, as the next reads it more than once."""
    read = written(reading(curve, by, level, ceiling, F.lit(scale), burst, quiet, floor, quiet_burst), "readings")
    found = written(calls(curve, by, level, read, gap, minimum), "calls")
    settled = written(settle(found, loudness, by, F.lit(margin), F.lit(hold), minimum), "settled")
    return sifted(settled, beats, by, density, places)


def sweep_sections(curve: DataFrame, loudness: DataFrame, beats: DataFrame | None, truth: DataFrame, by: list[str], level: str, scales: list[float], margins: list[float], holds: list[float], tolerance: float, ceiling: float = 0.5, gap: float = 2.0, burst: float = 5.0, minimum: float = 60.0, density: float = 0.5, quiet: float = 10.0, floor: float = 0.02, quiet_burst: float = 2.0, places: int = 3) -> DataFrame:
    """Every (scale, margin, hold) scored: truths, matched, invented, worst, and clean (all found, nothing invented). The
    curve is read once for all scales and cut once for each; margins and holds only walk the calls' starts."""
    scaled, set_ = [*by, "scale"], [*by, "scale", "margin", "hold"]
    each = lambda name, values: F.explode(F.array(*(F.lit(float(v)) for v in values))).alias(name)
    c = curve.select("*", each("scale", scales))
    read = written(reading(c, scaled, level, ceiling, F.col("scale"), burst, quiet, floor, quiet_burst), "readings")
    found = written(calls(c, scaled, level, read, gap, minimum), "calls").select("*", each("margin", margins)).select("*", each("hold", holds))
    spread = lambda df: df.select("*", each("scale", scales)).select("*", each("margin", margins)).select("*", each("hold", holds))
    settled = written(settle(found, spread(loudness), set_, F.col("margin"), F.col("hold"), minimum), "settled")
    s = sifted(settled, None if beats is None else spread(beats), set_, density, places)
    starts = s.where("outcome is null").select(*set_, F.col("start").alias("t"))
    m = J.match_truth(starts, spread(truth), set_, tolerance)
    return m.withColumn("clean", (F.col("matched") == F.col("truths")) & (F.col("invented") == 0))
