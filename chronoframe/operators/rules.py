"""Data-quality rules. Each gives findings: doc, rule, id, message, fix_hint, pos."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("doc", "rule", "id", "message", "fix_hint", "pos")


def found(df: DataFrame, rule: str, id: str | Column, message: Column | str, hint: str = "", pos: str = "pos") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    at = F.col(pos) if pos in df.columns else F.lit(0)
    return df.select("doc", F.lit(rule).alias("rule"), (F.col(id) if isinstance(id, str) else id).cast("string").alias("id"), text.alias("message"), F.lit(hint).alias("fix_hint"), at.cast("long").alias("pos"))


def rule_shape(docs: DataFrame, required: list[str], allowed: list[str]) -> DataFrame:
    """docs: doc, and body as a map of the keys of a document: keys that miss and keys not known."""
    keys = F.map_keys("body")
    miss = docs.select("doc", F.explode(F.array_except(F.array(*map(F.lit, required)), keys)).alias("id"))
    more = docs.select("doc", F.explode(F.array_except(keys, F.array(*map(F.lit, allowed)))).alias("id"))
    return found(miss, "E1", "id", "missing").union(found(more, "E1", "id", "unknown key"))


def rule_duplicate_id(rows: DataFrame, id: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("doc", id).orderBy("pos"))
    return found(rows.withColumn("_k", k).where("_k > 1"), "E2", id, "id used before")


def rule_range(rows: DataFrame, id: str, start: str, stop: str) -> DataFrame:
    return found(rows.where(F.col(start) >= F.col(stop)), "E3", id, "in is not before out")


def rule_reference(rows: DataFrame, declared: DataFrame, id: str, on: str) -> DataFrame:
    """Undeclared, or more than one declaration."""
    n = declared.groupBy(on).agg(F.count("*").alias("_n"))
    r = rows.join(n, on, "left").where("_n is null or _n > 1")
    return found(r, "E4", id, F.when(F.col("_n").isNull(), "undeclared").otherwise("ambiguous"))


def rule_bounds(rows: DataFrame, media: DataFrame, id: str, on: str, start: str, stop: str) -> DataFrame:
    """Outside the media (error), or its bounds unknown (warning); stills are exempt."""
    m = rows.join(media.select(on, "first", "last", "still"), on).where(~F.col("still"))
    out = (F.col(start) < F.col("first")) | (F.col(stop) > F.col("last"))
    unknown = F.col("first").isNull() | F.col("last").isNull()
    return found(m.where(out & ~unknown), "E5", id, "outside the media").union(found(m.where(unknown), "W9", id, "unknown bounds"))


def rule_rate(rows: DataFrame, media: DataFrame, id: str, on: str, fps: float) -> DataFrame:
    m = rows.join(media.select(on, "fps"), on)
    return found(m.where(F.abs(F.col("fps") - fps) > 0.01), "E6", id, "rate differs")


def rule_audio(docs: DataFrame, media: DataFrame, on: str) -> DataFrame:
    m = docs.join(media.select(on, "has_audio", "last"), on, "left")
    bad = F.when(F.col("has_audio").isNull(), "undeclared").when(~F.col("has_audio"), "has no audio").when(F.col("stop") > F.col("last"), "outside the media")
    return found(m.withColumn("_m", bad).where("_m is not null"), "E7", on, F.col("_m"))


def rule_alternate_length(rows: DataFrame, id: str, alternates: str) -> DataFrame:
    a = rows.select("doc", id, "pos", "duration", F.posexplode(alternates).alias("k", "alt"))
    return found(a.where(F.col("alt") != F.col("duration")), "E8", F.concat_ws("#", F.col(id).cast("string"), F.col("k").cast("string")), "alternate of another length")


def rule_overlay(overlays: DataFrame, anchors: DataFrame, totals: DataFrame, id: str) -> DataFrame:
    """First failure only: anchor, offset, end."""
    o = overlays.join(anchors.select("doc", F.col("pos").alias("anchor"), F.col("start").alias("_s"), F.col("duration").alias("_d")), ["doc", "anchor"], "left").join(totals, "doc")
    bad = F.when(F.col("_s").isNull(), "no such anchor").when((F.col("offset") < 0) | (F.col("offset") >= F.col("_d")), "offset outside the anchor").when(F.col("_s") + F.col("offset") + F.col("duration") > F.col("total"), "past the end")
    return found(o.withColumn("_m", bad).where("_m is not null"), "E9", id, F.col("_m"))


def rule_overlap(spans: DataFrame, id: str) -> DataFrame:
    from .windows import furthest_overlap

    return found(furthest_overlap(spans, ["doc"], id).where("overlaps is not null"), "E10", id, F.concat(F.lit("overlaps "), F.col("overlaps").cast("string")))


def rule_tail(rows: DataFrame, tails: DataFrame) -> DataFrame:
    """A tail fits inside the last item."""
    last = rows.groupBy("doc").agg(F.max_by("duration", "pos").alias("_d"), F.max("pos").alias("pos"))
    t = tails.join(last, "doc")
    return found(t.where(F.col("tail") > F.col("_d")), "E12", "pos", "tail longer than the last item")


def rule_short(rows: DataFrame, id: str, least: int = 12) -> DataFrame:
    return found(rows.where(F.col("duration") < least), "W1", id, "short")


def rule_span_mismatch(rows: DataFrame, audio: DataFrame) -> DataFrame:
    total = rows.groupBy("doc").agg(F.sum("duration").alias("_t"))
    return found(audio.join(total, "doc").where(F.col("span") != F.col("_t")), "W2", "doc", "audio span is not the total")


def rule_trailing_gap(rows: DataFrame, covers: DataFrame) -> DataFrame:
    """A gap after the last item that nothing else covers."""
    last = rows.groupBy("doc").agg(F.max_by("gap", "pos").alias("_g"), F.max(F.col("start") + F.col("duration")).alias("_end"))
    c = covers.groupBy("doc").agg(F.max("stop").alias("_c"))
    bad = last.join(c, "doc", "left").where((F.col("_g") > 0) & (F.coalesce("_c", F.lit(0)) < F.col("_end") + F.col("_g")))
    return found(bad, "W8", "doc", "black at the end")


def rule_fade_fit(rows: DataFrame, id: str) -> DataFrame:
    return found(rows.where((F.col("duration") > 0) & (F.col("fade_in") + F.col("fade_out") > F.col("duration"))), "T4", id, "fades longer than the item")


def rule_exclusive_fields(rows: DataFrame, id: str, route: str, fields: dict[str, str]) -> DataFrame:
    """Each route needs its own field and forbids the others'."""
    checks = []
    for r, f in fields.items():
        checks.append(F.when((F.col(route) == r) & F.col(f).isNull(), F.lit(f"{f} missing")))
        checks += [F.when((F.col(route) == r) & F.col(o).isNotNull(), F.lit(f"{o} not allowed")) for o in fields.values() if o != f]
    bad = rows.withColumn("_m", F.explode(F.array_compact(F.array(*checks))))
    return found(bad, "T6", id, F.col("_m"))


def rule_anchor_once(keys: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    n = anchors.groupBy("doc", key).agg(F.count("*").alias("_n"))
    k = keys.join(n, ["doc", key], "left").where(F.coalesce("_n", F.lit(0)) != 1)
    return found(k, "T7", key, F.when(F.col("_n").isNull(), "no anchor").otherwise("several anchors"))


def rule_asset(rows: DataFrame, files: DataFrame, id: str, on: str) -> DataFrame:
    """Asset missing, or with fewer frames than the item lasts."""
    r = rows.join(files.select(on, "frames"), on, "left")
    return found(r.where("frames is null"), "T10", id, "asset missing").union(found(r.where("frames < duration"), "T11", id, "too few frames"))


def rule_empty_parent(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return found(parents.join(children.select("doc", key), ["doc", key], "left_anti"), "W1", key, "without children")


def rule_unused(declared: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    return found(declared.join(uses.select("doc", key), ["doc", key], "left_anti"), "W2", key, "never used")


def rule_readback(rows: DataFrame, id: str, low: float = 0.5) -> DataFrame:
    """rows with clipped, repeated, confidence and jump: one finding for each that fails."""
    checks = F.array_compact(F.array(
        F.when(F.col("clipped").isNotNull(), F.struct(F.lit("W3").alias("r"), F.concat(F.lit("clipped where it "), F.col("clipped")).alias("m"))),
        F.when(F.col("repeated") >= 2, F.struct(F.lit("W4").alias("r"), F.lit("take repeated").alias("m"))),
        F.when(F.col("confidence").isNull(), F.struct(F.lit("W5").alias("r"), F.lit("no transcript").alias("m"))),
        F.when(F.col("confidence") < low, F.struct(F.lit("W6").alias("r"), F.lit("low confidence").alias("m"))),
        F.when(F.col("jump"), F.struct(F.lit("W7").alias("r"), F.lit("jump not covered").alias("m"))),
    ))
    e = rows.withColumn("_x", F.explode(checks))
    return e.select("doc", F.col("_x.r").alias("rule"), F.col(id).cast("string").alias("id"), F.col("_x.m").alias("message"), F.lit("").alias("fix_hint"), F.col("pos").cast("long").alias("pos"))


def findings(*frames: DataFrame) -> DataFrame:
    """All findings with their severity: W rules warn, the others are errors."""
    return reduce(DataFrame.unionByName, frames).withColumn("severity", F.when(F.col("rule").startswith("W"), "warning").otherwise("error"))


def gate(df: DataFrame, found: DataFrame) -> DataFrame:
    """df without documents that have errors; warnings never block."""
    return df.join(found.where("severity = 'error'").select("doc").distinct(), "doc", "left_anti")
