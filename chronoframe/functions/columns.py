"""Scalar functions: frames and seconds, timecode, ranges, names, levels and labels. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp with or without time zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def frames_from_seconds(seconds: Column, fps: float, snap: str = "in") -> Column:
    """In points floor, out points ceil, after rounding to 9 places so that 1001-rates slip no frame."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    at = F.round(seconds * F.lit(float(fps)), 9)
    return (F.floor(at) if snap == "in" else F.ceil(at)).cast("long")


def timecode(frames: Column, fps: float) -> Column:
    """HH:MM:SS:FF without drop frames, signed."""
    rate, n = max(round(fps), 1), F.abs(frames)
    whole = F.floor(n / rate)
    text = F.format_string("%02d:%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, n % rate)
    return F.when(frames < 0, F.concat(F.lit("-"), text)).otherwise(text)


def frames_from_timecode(text: Column, fps: float) -> Column:
    """Inverse of timecode(), blanks around it aside; null for drop-frame (;), malformed text and frames at or over the rate."""
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    rate = max(round(fps), 1)
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d+):(\d\d):(\d\d):(\d\d)$", k)
    n = lambda k: part(k).try_cast("long")
    frames = ((n(2) * 60 + n(3)) * 60 + n(4)) * rate + n(5)
    return F.when(n(5) < rate, F.when(part(1) == "-", -frames).otherwise(frames))


def dual_time(frames: Column, fps: float | None) -> Column:
    """Struct of frames, seconds (3 places), timecode and fps; frames alone where the rate is unknown; null in, null out."""
    known = fps is not None
    full = F.struct(
        frames.cast("long").alias("frames"),
        (F.round(frames / F.lit(float(fps)), 3) if known else F.lit(None).cast("double")).alias("seconds"),
        (timecode(frames, fps) if known else F.lit(None).cast("string")).alias("timecode"),
        F.lit(fps).cast("double").alias("fps"),
    )
    return F.when(frames.isNotNull(), full)


def to_frames(value: Column, fps: float, snap: str = "in") -> Column:
    """Frames from text that holds whole frames, decimal seconds or a timecode; null for anything else."""
    whole = F.when(value.rlike(r"^-?\d+$"), value.try_cast("long"))
    seconds = F.when(value.rlike(r"^-?\d*\.\d+$"), frames_from_seconds(value.try_cast("double"), fps, snap))
    return F.coalesce(whole, seconds, frames_from_timecode(value, fps))


def duration_frames(start: Column, end: Column) -> Column:
    return end - start


def ranges_overlap(a_in: Column, a_out: Column, b_in: Column, b_out: Column) -> Column:
    """Half-open ranges: touching is not overlap."""
    return (a_in < b_out) & (b_in < a_out)


def touches(first: Column, last: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Overlap with a window whose edges may be missing."""
    ok = F.lit(True)
    if high is not None:
        ok &= high.isNull() | (first < high)
    if low is not None:
        ok &= low.isNull() | (last > low)
    return ok


def strictly_inside(start: Column, end: Column, at: Column, guard: float = 0.0) -> Column:
    return (start + guard < at) & (at < end - guard)


def version_base(name: Column) -> Column:
    return F.when(name.rlike(r"^.+ v\d+$"), F.regexp_extract(name, r"^(.+) v\d+$", 1)).otherwise(name)


def version_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+ v(\d+)$", 1).try_cast("long")


def semitones(before: Column, after: Column) -> Column:
    return F.when((before > 0) & (after > 0), 12 * F.log2(after / before)).otherwise(0.0)


def _decibels(power: Column, offset: float, floor: float | None) -> Column:
    level = 10 * F.log10(power) - offset
    if floor is None:
        return F.when(power > 0, level).when(power == 0, float("-inf"))
    return F.when(power > 0, F.greatest(level, F.lit(floor))).otherwise(floor)


def dbfs(mean_square: Column, floor: float | None = -120.0) -> Column:
    """Silence and no value are at the floor; without one, silence is minus infinity and no value null."""
    return _decibels(mean_square, 0.0, floor)


def lufs(channels: list[Column], floor: float | None = -120.0) -> Column:
    """From mean squares of channels: 1.41 for those beyond the third, less 0.691. The floor is that of dbfs()."""
    total = reduce(lambda a, b: a + b, (c * (1.0 if k < 3 else 1.41) for k, c in enumerate(channels)))
    return _decibels(total, 0.691, floor)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def linear_score(x: Column, full: float, zero: float = 1.0) -> Column:
    return clamp01((x - zero) / (full - zero))


def parse_label(entry: Column) -> Column:
    """Struct of subject and voice from '<subject>-<character>' or a JSON object with role, subject and voice; blank is null, a missing voice is the subject."""
    is_json = F.trim(entry).startswith("{")
    field = lambda name: F.when(is_json, F.nullif(F.trim(F.get_json_object(entry, f"$.{name}")), F.lit("")))
    plain = F.when(~is_json, F.nullif(F.trim(F.substring_index(entry, "-", 1)), F.lit("")))
    subject = F.coalesce(field("subject"), plain)
    return F.struct(field("role").alias("role"), subject.alias("subject"), F.coalesce(field("voice"), subject).alias("voice"))


def label_kind(subject: Column, known: list[str] | None) -> Column:
    """ensemble, player or other; other only where a roster exists."""
    other = ~subject.isin(*known) if known else F.lit(False)
    return F.when(subject.isNull(), None).when(subject == "ensemble", "ensemble").when(subject.startswith("follow"), "player").when(other, "other").otherwise("player")


def classify_path(path: Column) -> Column:
    """graphics, audio or footage, by the extension of the last part of the path; footage is whatever is neither of the others."""
    # fixed values: extensions of still images, drawings and sound
    graphics = "png jpg jpeg tif tiff exr dpx tga ai eps psd svg".split()
    audio = "aac aif aiff flac m4a mp3 ogg wav".split()
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.when(ext.isin(*graphics), "graphics").when(ext.isin(*audio), "audio").otherwise("footage")


def first_non_empty(columns: list[tuple[str, Column]]) -> Column:
    """Struct of the first value that is not blank, trimmed, and the name of its source."""
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(F.coalesce(*(value(c) for _, c in columns)).alias("value"), F.coalesce(*(F.when(value(c).isNotNull(), n) for n, c in columns)).alias("source"))


def frame_bounds(start: Column, end: Column, frames: Column, duration_tc: Column, fps: float) -> Column:
    """Exclusive end: end + 1, else start + frames, else start + duration at a known rate, else unknown."""
    return F.coalesce(end + 1, start + frames, start + frames_from_timecode(duration_tc, fps))


def unfold_sequence_name(path: Column) -> Column:
    """name.[001-090].png is its first frame's path."""
    return F.regexp_replace(path, r"\[(\d+)-\d+\]", "$1")


def spoken_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", "")), lambda w: w != "")


def bar_line_strength(downbeat: Column, bar: Column) -> Column:
    return F.when(downbeat & (F.pmod(bar - 1, F.lit(4)) == 0), 1.0).when(downbeat, 0.6).otherwise(0.15)


def floor_misses(sharpness: Column, clipped: Column, stability: Column, floors: dict[str, float]) -> Column:
    """Names of the floors missed; a null stability never fails."""
    return F.array_compact(F.array(F.when(sharpness < floors["sharpness"], "soft"), F.when(clipped > floors["clipped"], "clipped"), F.when(stability < floors["stability"], "shaky")))


def severity(sharpness: Column, clipped: Column, stability: Column, floors: dict[str, float]) -> Column:
    """Largest shortfall in proportion to its floor, 0 to 1."""
    short = lambda v, f: F.coalesce((F.lit(f) - v) / F.lit(f), F.lit(0.0))
    return clamp01(F.greatest(short(sharpness, floors["sharpness"]), F.coalesce((clipped - floors["clipped"]) / F.lit(floors["clipped"]), F.lit(0.0)), short(stability, floors["stability"])))


def step_reason(layout: Column, structure: Column, scale: Column, same: float = 0.2) -> Column:
    """Which of angle and size failed to change under a flagged step."""
    angle, size = F.greatest(layout, structure) < same, scale < same
    return F.when(angle & size, "same angle and size").when(angle, "same angle").when(size, "same size")
