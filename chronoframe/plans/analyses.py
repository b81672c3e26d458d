"""Further analyses built from the operators (I): bar maps, bursts over a baseline, phrases, quiet passages, read-back, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bar_line_strength, clamp01, semitones
from ..operators import aggregates as A
from ..operators import islands as I
from ..operators import joins as J
from ..operators import windows as W
from ..sources.catalog import written

#: Fixed values of a bar map: rates a pulse may have per minute, folds and meters tried, and the weights of contrast,
#: margin and agreement in its confidence.
RATES, FOLDS, METERS = (60.0, 200.0), (2, 3, 4), (4, 3, 2)
WEIGHTS = (0.35, 0.25, 0.40)
FOLD_MARGIN, SIGMAS, FULL_CONTRAST, FULL_MARGIN, WINDOW_BARS, FEWEST_BEATS, FEWEST_BARS = 0.15, 3.0, 1.0, 0.5, 4, 4, 2


def _pairs(sizes: tuple[int, ...]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("size"), F.lit(p).alias("phase")) for k in sizes for p in range(k)))).alias("c")


def _barrings(pulse: DataFrame, by: list[str]) -> DataFrame:
    """Per key the meter and phase whose bar lines stand out most, and by how much over the next best. pulse: by, k from 0, value."""
    c = pulse.select(*by, "k", "value", _pairs(METERS)).select(*by, "k", "value", "c.*").withColumn("on", F.col("k") % F.col("size") == F.col("phase"))
    c = c.groupBy(*by, "size", "phase").agg(A.contrast("value", F.col("on")).alias("contrast"), F.count_if("on").alias("lines"), F.count("*").alias("n"))
    c = c.where((F.col("lines") >= FEWEST_BARS) & (F.col("n") >= FEWEST_BARS * min(METERS)))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("contrast", 6)), "size", "phase")
    c = c.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("contrast").over(w), F.lit(0.0))}).where("_r = 1")
    return c.select(*by, F.col("size").alias("meter"), "phase", "contrast", F.greatest(F.col("contrast") - F.col("_next"), F.lit(0.0)).alias("margin"))


def bar_map(beats: DataFrame, by: list[str], least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """One row per key: meter, source (model, inferred or refused), confidence, fold and its phase and reason, agreement;
    and the bars of the keys that are not refused: bar, t, seconds, beats, beat, in_group. beats: t, beat, bar, salience.

    A grid whose own bars mostly have one length is taken at its word. Else the pulse is the grid, or every k-th beat where
    only that has a rate inside RATES; meter and phase are those whose bar lines stand out most; the confidence weighs
    contrast, margin over the next best and how many windows of four bars agree by themselves. What is read more than once, the
    levelled beats first, is written to the shared folder."""
    key, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("t")
    b = W.levelled(beats, by, "salience").withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(key)} | {f"_t{k}": F.lead("t", k).over(w) for k in (1, *FOLDS)})
    b = written(b, "beats")
    own = A.modal_size(b, by, "bar")

    # the pulse
    c = b.select(*by, "t", "i", "n", F.col("levelled").alias("value"), *(f"_t{k}" for k in (1, *FOLDS)))
    rate = lambda gap: 60 / F.median(F.when(gap > 0, gap))
    given = c.groupBy(*by).agg(rate(F.col("_t1") - F.col("t")).alias("given"), F.count("*").alias("n"))
    later = F.coalesce(*(F.when(F.col("size") == k, F.col(f"_t{k}")) for k in FOLDS))
    f = c.select("*", _pairs(FOLDS)).select("*", "c.*").withColumn("on", F.col("i") % F.col("size") == F.col("phase"))
    f = f.groupBy(*by, "size", "phase").agg(A.contrast("value", F.col("on")).alias("contrast"), F.count_if("on").alias("inside"), F.count("*").alias("n"), rate(F.when(F.col("on"), later - F.col("t"))).alias("rate"))
    floor = F.greatest(F.lit(FOLD_MARGIN), SIGMAS * F.sqrt(1 / F.col("inside") + 1 / (F.col("n") - F.col("inside"))))
    f = f.where((F.col("inside") >= FEWEST_BEATS) & F.col("rate").between(*RATES)).withColumn("accent", F.col("contrast") >= floor)
    accents = F.max("accent").over(key)
    order = F.when(accents, F.struct(F.round("contrast", 6).alias("x"), (-F.col("size")).alias("y"), (-F.col("phase")).alias("z"))).otherwise(F.struct(F.lit(0.0).alias("x"), (-F.col("size")).alias("y"), (-F.col("phase")).alias("z")))
    f = f.withColumn("_o", order).groupBy(*by).agg(F.max_by(F.struct("size", "phase", "accent"), "_o").alias("f"))
    g = given.join(f, by, "left").join(own, by)
    folded = (F.col("n") >= FEWEST_BEATS) & F.col("given").isNotNull() & ~F.col("given").between(*RATES) & F.col("f").isNotNull() & ~F.col("committed")
    g = g.select(*by, "committed", F.col("size").alias("own"), F.col("share"), F.when(folded, F.col("f.size")).otherwise(1).alias("fold"), F.when(folded, F.col("f.phase")).otherwise(0).alias("fold_phase"),
                 F.when(F.col("committed"), "model").when(folded & F.col("f.accent"), "accent").when(folded, "tempo").otherwise("given").alias("fold_reason"))
    g = written(g, "folds")

    # its bars
    p = b.join(g, by).where((F.col("i") % F.col("fold") == F.col("fold_phase")) & ~F.col("committed"))
    p = p.select(*by, F.floor(F.col("i") / F.col("fold")).alias("k"), F.col("levelled").alias("value"))
    read = written(_barrings(p, by), "barrings")
    inside = p.join(read.select(*by, "meter", "phase"), by).withColumn("block", F.floor(F.col("k") / (WINDOW_BARS * F.col("meter"))))
    size = Window.partitionBy(*by, "block")
    inside = inside.withColumns({"_n": F.count("*").over(size), "start": F.min("k").over(size)}).where(F.col("_n") == WINDOW_BARS * F.col("meter"))
    alike = inside.select(*by, "block", "start", F.col("meter").alias("m"), F.col("phase").alias("p"), (F.col("k") - F.col("start")).alias("k"), "value")
    alike = _barrings(alike, [*by, "block", "start", "m", "p"]).where("contrast > 0")
    same = (F.col("meter") == F.col("m")) & ((F.col("start") + F.col("phase")) % F.col("m") == F.col("p"))
    held = alike.groupBy(*by).agg(F.avg(same.cast("double")).alias("agreement"), F.count("*").alias("_c")).where("_c >= 2").drop("_c")
    s = g.join(read, by, "left").join(held, by, "left")
    scored = WEIGHTS[0] * clamp01(F.col("contrast") / FULL_CONTRAST) + WEIGHTS[1] * clamp01(F.col("margin") / FULL_MARGIN)
    sure = F.when(F.col("agreement").isNull(), clamp01(scored / (WEIGHTS[0] + WEIGHTS[1]))).otherwise(clamp01(scored + WEIGHTS[2] * F.col("agreement")))
    s = s.withColumn("confidence", F.when(F.col("committed"), F.col("share")).otherwise(F.coalesce(sure, F.lit(0.0))))
    source = F.when(F.col("confidence") < least, "refused").when(F.col("committed"), "model").when(F.col("meter").isNull(), "refused").otherwise("inferred")
    s = s.select(*by, F.when(source != "refused", F.when(F.col("committed"), F.col("own")).otherwise(F.col("meter"))).alias("meter"), source.alias("source"), F.round("confidence", 3).alias("confidence"),
                 "fold", "fold_phase", "fold_reason", F.round("agreement", 3).alias("agreement"), F.col("phase").alias("_phase"))

    # the bars themselves: a row opens one where the grid's bar changes, or on the meter's line and at the pickup
    line = b.join(s.where("source <> 'refused'"), by).withColumn("_k", (F.col("i") - F.col("fold_phase")) / F.col("fold"))
    line = line.where((F.col("source") == "model") | (F.col("i") % F.col("fold") == F.col("fold_phase")))
    opens = F.when(F.col("source") == "model", ~F.coalesce(F.lag("bar").over(w) == F.col("bar"), F.lit(False))).otherwise((F.pmod(F.col("_k") - F.col("_phase"), F.col("meter")) == 0) | (F.col("_k") == 0))
    line = line.withColumns({"_o": opens, "_j": F.row_number().over(w)}).withColumn("_end", F.max("_j").over(key) + 1).where("_o")
    number = F.row_number().over(w)
    bars = line.select(*by, number.alias("bar"), F.round("t", 3).alias("t"), F.round(F.lead("t").over(w) - F.col("t"), 3).alias("seconds"), (F.coalesce(F.lead("_j").over(w), F.col("_end")) - F.col("_j")).alias("beats"),
                       "beat", ((number - 1) % 4 + 1).alias("in_group"))
    return s.drop("_phase"), bars


def bursts_over_baseline(hits: DataFrame, grid: DataFrame, by: list[str], stem: str, tom: str, cymbal: str, half: int = 32, skip: int = 8, least: float = 0.35) -> DataFrame:
    """Runs of beats that are busier than usual: by density over the key's median, or by hits over each stem's own baseline
    around. confidence: density, share of toms, whether a hit resolves the run, and the bar line it leads to."""
    w = Window.partitionBy(*by).orderBy("t")
    g = grid.withColumn("k", F.row_number().over(w).cast("long")).withColumn("_gap", F.lead("t").over(w) - F.col("t"))
    usual = g.groupBy(*by).agg(F.median(F.when(F.col("_gap") > 0, F.col("_gap"))).alias("_usual"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    g = g.join(usual, by).withColumn("close", F.col("t") + F.coalesce("_gap", "_usual", F.lit(1.0))).drop("_gap", "_usual")
    at = J.asof_join(hits.select(*by, "t", F.col(stem).alias("stem")), g.select(*by, "t", "k", "close"), by, ["k", "close"]).where(F.col("t") < F.col("r_close"))
    tally = at.groupBy(*by, F.col("r_k").alias("k"), "stem").agg(F.count("*").cast("double").alias("n"))
    cells = g.select(*by, "k", (F.col("close") - F.col("t")).alias("len"), F.col("k").cast("double").alias("t")).join(tally.select(*by, "stem").distinct(), by)
    cells = cells.join(tally, [*by, "k", "stem"], "left").fillna(0.0, ["n"])
    cells = W.local_baseline_excluding(cells, [*by, "stem"], "n", half, skip).withColumn("_over", F.greatest(F.col("n") - F.coalesce("baseline", F.lit(0.0)), F.lit(0.0)))
    beat = cells.groupBy(*by, "k").agg(F.sum("n").alias("total"), F.sum("_over").alias("over"), F.sum(F.when(F.col("stem") == tom, F.col("n")).otherwise(0.0)).alias("toms"), F.sum(F.when(F.col("stem") == cymbal, F.col("n")).otherwise(0.0)).alias("cymbals"), F.first("len").alias("len"))
    beat = beat.withColumn("density", F.col("total") / F.col("len"))
    base = beat.groupBy(*by).agg(F.median("density").alias("_base")).where("_base > 0")
    beat = beat.join(base, by)
    busy = ((F.col("density") >= 1.6 * F.col("_base")) & (F.col("total") >= 3)) | (F.col("over") >= 3)
    runs = I.index_runs(beat, by, "k", busy, 1).where(F.col("end") - F.col("first") <= 8).withColumn("last", F.col("end") - 1)
    inside = runs.select(*by, "first", "last", F.explode(F.sequence("first", "last")).alias("k")).join(beat, [*by, "k"])
    summed = inside.groupBy(*by, "first", "last").agg(*(F.sum(c).alias(c) for c in ("total", "toms", "cymbals")), F.first("_base").alias("_base"))
    place = lambda k, *cols: g.select(*by, F.col("k").alias(k), *cols)
    r = summed.join(place("first", F.col("t").alias("start")), [*by, "first"]).join(place("last", F.col("close").alias("stop")), [*by, "last"])
    r = r.withColumn("_into", F.col("last") + 1).join(place("_into", "downbeat", "bar"), [*by, "_into"], "left")
    near = J.nearest_join(r.withColumn("t", F.col("stop")), hits.select(*by, "t"), by, ["t"]).withColumn("_off", F.abs("offset"))
    length = F.col("last") - F.col("first") + 1
    density = F.col("total") / (F.col("stop") - F.col("start"))
    kit = F.col("total") - F.col("cymbals")
    parts = (
        0.35 * clamp01((density / F.col("_base") - 1) / 2), 0.25 * F.when(kit > 0, clamp01(F.col("toms") / kit / 0.5)).otherwise(0.0),
        0.15 * F.coalesce(F.col("_off") <= 0.25 * (F.col("stop") - F.col("start")) / length, F.lit(False)).cast("double"), 0.25 * bar_line_strength(F.coalesce("downbeat", F.lit(False)), F.coalesce("bar", F.lit(0))),
    )
    out = near.withColumn("confidence", F.round(clamp01(parts[0] + parts[1] + parts[2] + parts[3]), 3)).where(F.col("confidence") >= least)
    return out.select(*by, "first", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"), length.alias("beats"), F.col("total").cast("long").alias("hits"), "confidence")


def phrase_boundaries(notes: DataFrame, grid: DataFrame, by: list[str], least: float = 0.35, chunk: int = 4096) -> DataFrame:
    """Ends of notes that end a phrase: by the rest after them, how long they are held or the leap that follows. The strongest
    cue carries the confidence, the mean of the others and the bar line add to it; two ends need two beats between them, kept in order
    of the notes, `chunk` of them in a task. The ends are written to the shared folder, as they are read twice."""
    w = Window.partitionBy(*by).orderBy("t", "end")
    step = grid.select(*by, (F.lead("t").over(Window.partitionBy(*by).orderBy("t")) - F.col("t")).alias("s"))
    beat = step.groupBy(*by).agg(F.median(F.when(F.col("s") > 0, F.col("s"))).alias("beat")).where("beat is not null")
    n = notes.withColumns({"i": F.row_number().over(w), "resumes": F.lead("t").over(w), "_hz": F.lead("hz").over(w), "held": F.col("end") - F.col("t")}).join(beat, by)
    usual = n.groupBy(*by).agg(F.median("held").alias("usual"), F.count("*").alias("_n")).where("usual > 0 and _n > 1").drop("_n")
    n = n.join(usual, by).withColumn("rest", F.when(F.col("resumes").isNotNull(), F.greatest(F.col("resumes") - F.col("end"), F.lit(0.0))))
    leap = F.when((F.col("hz") > 0) & (F.col("_hz") > 0), F.abs(semitones(F.col("hz"), F.col("_hz"))))
    n = n.withColumn("leap", leap).where(F.col("resumes").isNull() | (F.col("rest") >= 0.5 * F.col("beat")) | (F.col("held") >= 1.6 * F.col("usual")) | (F.col("leap") >= 7))
    n = n.select(*by, "i", F.col("end").alias("t"), "resumes", "beat", "usual", "held", "rest", "leap")
    g = grid.select(*by, "t", "bar", "downbeat")
    # called at the first beat inside the rest, else at the nearest beat within one, else at the end itself
    c = J.asof_join(n, g, by, ["t"], forward=True, prefix="next_")
    c = J.nearest_join(c, g, by, ["t"], prefix="near_").drop("offset")
    inner = F.when(F.col("next_t").isNotNull() & F.coalesce(F.col("next_t") <= F.col("resumes"), F.lit(True)), F.col("next_t"))
    c = c.withColumn("called", F.coalesce(inner, F.when(F.abs(F.col("near_t") - F.col("t")) <= F.col("beat"), F.col("near_t")), F.col("t")))
    c = J.asof_join(c.withColumnsRenamed({"t": "measured", "called": "t"}), g, by, ["bar", "downbeat"])
    cues = F.array_sort(F.array(F.when(F.col("rest").isNull(), 1.0).otherwise(clamp01(F.col("rest") / (2 * F.col("beat")))), clamp01((F.col("held") / F.col("usual") - 1) / 2), F.coalesce(clamp01(F.col("leap") / 12), F.lit(0.0))))
    line = bar_line_strength(F.coalesce("r_downbeat", F.lit(False)), F.coalesce("r_bar", F.lit(0)))
    sure = clamp01(0.55 * F.element_at(cues, 3) + 0.2 * (F.element_at(cues, 2) + F.element_at(cues, 1)) / 2 + 0.25 * line)
    c = c.withColumn("confidence", F.round(sure, 3)).where(F.col("confidence") >= least)
    c = written(c.select(*by, "i", "t", "measured", "beat", "confidence"), "ends")
    # in order of the notes: two beats after the end kept last
    ends = c.select(*by, "i", (F.col("measured") / F.col("beat")).alias("at"))
    kept = I.fold_in_chunks(ends, by, ["i"], F.floor(F.col("i") / chunk).cast("long"), I.Spacing("at", 2.0, "i"), "i long")
    v = Window.partitionBy(*by).orderBy("i")
    return c.join(kept, [*by, "i"]).select(*by, F.round("t", 3).alias("t"), F.round("measured", 3).alias("measured"), (F.col("i") - F.coalesce(F.lag("i").over(v), F.lit(0))).alias("notes"), "confidence")


def quiet_floor(items: DataFrame, levels: DataFrame, by: list[str], width: float, least: float, floor: float = 0.65) -> DataFrame:
    """Per quiet passage (the lowest third of the smoothed levels, `least` seconds or longer): items that start in it, their
    rate per minute, variation with and without orphans, the item that holds through it, and whether it reads as locked."""
    s = W.terciles(W.moving_median(levels, by, "level").drop("level"), by, "smooth").withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("t")).cast("long"))
    p = I.index_runs(s, by, "n", F.col("tercile") == "quiet", 0, [F.min("t").alias("start"), (F.max("t") + width).alias("stop")]).where(F.col("stop") - F.col("start") >= least).select(*by, "start", "stop")
    hit = J.point_in_interval(items, p.withColumn("passage", F.col("start")), by, ["passage"]).where("r_passage is not null").withColumnRenamed("r_passage", "start")
    hit = W.orphans(hit, [*by, "start"], "seconds")
    kept = F.when(~F.col("orphan"), F.col("seconds"))
    spread = lambda c: F.when(F.count(c) > 1, F.round(F.stddev_pop(c) / F.avg(c), 4))
    cut = hit.groupBy(*by, "start").agg(F.count("*").alias("items"), F.round(F.median("seconds"), 3).alias("median"), spread(F.col("seconds")).alias("cv"), F.count_if("orphan").alias("orphans"), spread(kept).alias("cv_less_orphans"))
    through = J.asof_join(p.withColumn("t", F.col("start")), items.select(*by, "t", "seconds"), by, ["t", "seconds"]).where(F.col("r_t") + F.col("r_seconds") >= F.col("stop")).select(*by, "start", F.col("r_seconds").alias("_held"))
    r = p.join(cut, [*by, "start"], "left").join(through, [*by, "start"], "left").fillna(0, ["items", "orphans"])
    held = F.when(F.col("items") == 0, F.col("_held"))
    locked = held.isNotNull() | F.coalesce(F.col("cv_less_orphans") < floor, F.lit(False))
    return r.select(*by, "start", "stop", "items", F.round(60 * F.col("items") / (F.col("stop") - F.col("start")), 4).alias("rate"), "median", "cv", "orphans", "cv_less_orphans", held.alias("held_through"), locked.alias("locked"))


def readback(segments: DataFrame, words: DataFrame, by: list[str], low: float) -> DataFrame:
    """Per segment (pos, source, s_in, s_out) the words of its source that it will hold, in order: text, words, unsure ones,
    clipped ones; whether it repeats the end of the segment before it, and jumps within one source. Null counts: the source
    has no words at all. words: source, w_in, w_out, word, confidence."""
    segs = W.sequential_layout(segments.withColumn("duration", F.col("s_out") - F.col("s_in")), by)
    known = words.select("source").distinct().withColumn("_known", F.lit(True))
    m = J.words_in_segment(words, segs.select(*by, "pos", "source", "s_in", "s_out"), ["source"])
    kept = F.when(F.col("clipped").isNull(), F.struct("w_in", "w_out", "word"))
    line = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["word"])
    inside = F.col("clipped").isNull()
    got = m.groupBy(*by, "pos").agg(line.alias("said"), F.count_if(inside & (F.col("confidence") < low)).alias("unsure"), F.count_if(~inside).alias("clipped"))
    r = W.jump_seams(segs.join(known, "source", "left").join(got, [*by, "pos"], "left"), by)
    r = r.withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    r = W.repeated_seam(r, by, "said", "pos")
    n = lambda c: F.when(F.col("_known"), F.coalesce(c, F.lit(0)))
    return r.select(*by, "pos", "source", "start", n(F.size("said")).cast("long").alias("words"), F.array_join("said", " ").alias("text"), n(F.col("unsure")).alias("unsure"), n(F.col("clipped")).alias("clipped"), F.col("repeated").cast("long").alias("repeated"), "jump")


def classify_windows(features: DataFrame, by: list[str], level: str, seed: Column, hold: Column, bridge: int, quiet: float = 0.2, gap: float = 6.0, margin: float = 6.0, headroom: float = 3.0) -> DataFrame:
    """Each row's class: noisy where grown from seeds, silence at or under a floor that must lie well under the quiet rows,
    music elsewhere; single rows between two of one other class take theirs, but for noisy ones."""
    key, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("t")
    f = features.withColumn("n", F.row_number().over(w).cast("long"))
    band, least = F.percentile(level, F.lit(quiet)).over(key), F.min(level).over(key)
    f = f.withColumns({"_band": band, "_least": least})
    at = F.when(F.col("_least") <= F.col("_band") - gap, F.least(F.col("_least") + margin, F.col("_band") - headroom))
    runs = I.seed_and_grow(f, by, "n", seed, hold, bridge).select(*by, F.explode(F.sequence("first", F.col("end") - 1)).alias("n"), F.lit(True).alias("_noisy"))
    label = F.when(F.col("_noisy"), "noisy").when(F.coalesce(F.col(level) <= at, F.lit(False)), "silence").otherwise("music")
    f = f.join(runs, [*by, "n"], "left").withColumn("label", label)
    return W.isolated_label_smooth(f, by, "label", "noisy").select(*by, "t", F.col("smooth").alias("label"))
