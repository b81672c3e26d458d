"""Analyses that SQL doesn't express, against plain loops over one key at a time."""

import math
from collections import defaultdict
from statistics import mean, median, pstdev

import numpy as np
import pytest

from chronoframe.operators import islands as I
from chronoframe.operators import shapes as S
from chronoframe.operators import vectors as V
from chronoframe.plans import QUERIES, analyses, analysis_queries, shape_queries


def grouped(df, key, order):
    out = defaultdict(list)
    for r in df.orderBy(order).collect():
        out[r[key] if isinstance(key, str) else tuple(r[k] for k in key)].append(r)
    return out


def test_vector_step(spark, sf_dir):
    got = {(r.label, r.pos): r for r in V.vector_step(shape_queries.pictures(spark, sf_dir), ["label"], "vec", "pos", 8).collect()}

    def profile(a, b):
        a, b = [x - mean(a) for x in a], [x - mean(b) for x in b]
        score = {}
        for k in (-1, 0, 1):
            p = [(a[i], b[i - k]) for i in range(8) if 0 <= i - k < 8]
            score[k] = sum(x * y for x, y in p) / math.sqrt(sum(x * x for x, _ in p) * sum(y * y for _, y in p))
        best = max(score, key=score.get)
        return max(0.0, score[0] if abs(best) == 1 else score[best])

    def width(rows):
        mass = [sum(r) / 8 for r in rows]
        mass = [m - min(mass) for m in mass]
        middle = sum(m * i / 8 for i, m in enumerate(mass)) / sum(mass)
        return math.sqrt(sum(m * (i / 8 - middle) ** 2 for i, m in enumerate(mass)) / sum(mass))

    for label, rows in grouped(shape_queries.pictures(spark, sf_dir), "label", "pos").items():
        assert got[label, 1].delta is None
        for before, after in zip(rows, rows[1:]):
            pair = [[list(v.vec[8 * i : 8 * i + 8]) for i in range(8)] for v in (before, after)]
            turned = [[list(c) for c in zip(*p)] for p in pair]
            bins = [[sum(min(31, int(x * 32)) == k for x in v.vec if 0 <= x <= 1) / 64 for k in range(32)] for v in (before, after)]
            content = sum(abs(a - b) for a, b in zip(*bins)) / 2
            layout = 1 - (profile(*[[mean(c) for c in t] for t in turned]) + profile(*[[mean(r) for r in p] for p in pair])) / 2
            blocks = [[mean(p[2 * y][x : x + 1] + p[2 * y + 1][x : x + 1]) for y in range(4) for x in range(8)] for p in pair]
            a, b = ([x - mean(v) for x in v] for v in blocks)
            structure = 1 - max(0, sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)))
            size = [math.sqrt(width(p) * width(t)) for p, t in zip(pair, turned)]
            scale = min(1, abs(math.log2(size[1] / size[0])))
            r = got[label, after.pos]
            for have, want in ((r.content, content), (r.layout, layout), (r.structure, structure), (r.scale, scale), (r.delta, 0.3 * layout + 0.25 * structure + 0.3 * content + 0.15 * scale)):
                assert abs(have - want) < 2e-4, (label, after.pos, have, want)
            assert r.jump == (r.delta < 0.2) or abs(r.delta - 0.2) < 1e-3


def test_vector_step_edges(spark):
    flat, spot = [0.5] * 64, [1.0 if i == 9 else 0.0 for i in range(64)]
    rows = [(1, k, v) for k, v in enumerate([flat, flat, spot, None, spot, spot])]
    got = {r.pos: r for r in V.vector_step(spark.createDataFrame(rows, "label int, pos int, vec array<double>"), ["label"], "vec", "pos", 8).collect()}
    assert (got[1].delta, got[1].jump) == (0.0, True) and (got[5].delta, got[5].jump) == (0.0, True)
    assert got[2].layout == got[2].structure == 1.0 and got[2].scale == 0.0 and got[0].delta is got[3].delta is got[4].delta is None


@pytest.mark.parametrize("kind, rows", [
    ("none", [5, 5.2, 5, 5.1, 5]), ("hard", [50, 50, 90, 90, 90]), ("dissolve", [50, 50, 60, 70, 80, 90, 90]), ("fade", [80, 60, 40, 20, 5, 5]), ("unknown", [1, 9]), ("hard", [50, 50, 95, 45, 90, 90]),
])
def test_transition_kinds(spark, kind, rows):
    df = spark.createDataFrame([(1, float(t), [v, v * 0.7]) for t, v in enumerate(map(float, rows))], "k int, t double, vec array<double>")
    if kind == "hard" and rows[3] == 45:  # a ramp by size whose middle is no blend of its ends
        rows = [(50.0, 50.0), (50.0, 50.0), (95.0, 10.0), (10.0, 95.0), (90.0, 90.0), (90.0, 90.0)]
        df = spark.createDataFrame([(1, float(t), list(v)) for t, v in enumerate(rows)], "k int, t double, vec array<double>")
    assert S.transition_kind(df, ["k"], "vec").collect()[0].kind == kind


def test_ghost_events(spark):
    rng = np.random.default_rng(1)
    frames = [rng.random(16) * 100 for _ in range(40)]
    for i in (10, 11, 25):
        frames[i] = 0.4 * frames[i - 3] + 0.6 * frames[i + 3] + rng.random(16)
    df = spark.createDataFrame([(1, i, f.tolist()) for i, f in enumerate(frames)], "k int, i int, vec array<double>")
    got = sorted((r.first, r.end) for r in V.ghost_events(df, ["k"], "vec", "i", 3, 8.0, 5).collect())
    assert got == [(10, 12), (25, 26)]


def test_span_groups(spark, sf_dir):
    got = defaultdict(list)
    for r in QUERIES["f18_span_groups"](spark, sf_dir).collect():
        got[r.rec_id].append((r.start, r.stop, tuple(r.held), r.readings))
    for rec, rows in grouped(analysis_queries.recordings(spark, sf_dir), "rec_id", "t").items():
        groups = []
        for r in rows:
            mask = {k for k in range(16) if r.event_id * (k + 7) % 5 > 1}
            for g in groups:
                if r.t <= g["stop"] + 86400 and len(g["held"] & mask) >= 4:
                    g["stop"] = max(g["stop"], r.t + 600)
                    g["held"] &= mask
                    g["n"] += 1
                    break
            else:
                groups.append({"start": r.t, "stop": r.t + 600, "held": set(mask), "n": 1})
        assert sorted(got[rec]) == sorted((g["start"], g["stop"], tuple(sorted(g["held"])), g["n"]) for g in groups)


def test_note_spans(spark):
    # gate opens at 0.15 of the peak and closes under 0.06; the pitch moves by an octave for two rows, then for one only
    rows = [(0.01, 0), (0.2, 440), (1.0, 440), (0.5, 440), (0.5, 880), (0.5, 880), (0.5, 880), (0.5, 440), (0.5, 880), (0.1, 880), (0.05, 880), (0.12, 300), (0.3, 300), (0.2, 0), (0.2, 300), (0.2, 300), (0.2, 300), (0.2, 300)]
    df = spark.createDataFrame([("a", i * 0.02, float(hz), level) for i, (level, hz) in enumerate(rows)], "k string, t double, hz double, level double")
    got = sorted(tuple(r)[1:] for r in I.note_spans(df, ["k"], "k string").drop("run").collect())
    assert [(a, b, hz) for a, b, hz, _ in got] == [(0.08, 0.158, 880.0), (0.262, 0.318, 300.0)] and got[0][3] == 0.5
    assert I.note_spans(df.limit(0), ["k"], "k string").collect() == []


def bar_map(rows):
    """Plain reading of one grid: (meter, source, confidence, fold, phase, agreement) and the bars' first rows."""
    level = [r.salience for r in rows]
    t = [r.t for r in rows]
    value = []
    for i in range(len(rows)):
        m = median(level[max(0, i - 16) :][:33])
        value.append(level[i] / m if m > 0 else 0.0)

    def contrast(v, size, phase):
        inside, outside = v[phase::size], [x for i, x in enumerate(v) if i % size != phase]
        return (mean(inside) - mean(outside)) / pstdev(v) if inside and outside and pstdev(v) > 0 else 0.0

    def rate(times):
        gaps = [b - a for a, b in zip(times, times[1:]) if b > a]
        return 60 / median(gaps) if gaps else None

    def barring(v):
        if len(v) < 4:
            return None
        c = [(-round(contrast(v, m, p), 6), m, p, contrast(v, m, p)) for m in (2, 3, 4) for p in range(m) if len(v[p::m]) >= 2]
        c.sort()
        return (c[0][1], c[0][2], c[0][3], max(c[0][3] - (c[1][3] if len(c) > 1 else 0), 0)) if c else None

    sizes = list({b: sum(r.bar == b for r in rows) for b in [r.bar for r in rows]}.values())
    modal = max(sizes, key=lambda s: (sizes.count(s), -sizes.index(s)))
    share = sizes.count(modal) / len(sizes)
    if modal >= 2 and share >= 0.8:
        starts = [i for i, r in enumerate(rows) if i == 0 or rows[i - 1].bar != r.bar]
        return (modal, "model", round(share, 3), 1, 0, None), starts
    fold, phase = 1, 0
    given = rate(t)
    if len(rows) >= 4 and given and not 60 <= given <= 200:
        c = []
        for f in (2, 3, 4):
            for p in range(f):
                r, n = rate(t[p::f]), len(t[p::f])
                if n >= 4 and r and 60 <= r <= 200:
                    x = contrast(value, f, p)
                    c.append((x >= max(0.15, 3 * math.sqrt(1 / n + 1 / (len(t) - n))), round(x, 6), -f, -p))
        if c:
            best = max(c, key=lambda k: k[1:]) if any(k[0] for k in c) else max(c, key=lambda k: k[2:])
            fold, phase = -best[2], -best[3]
    pulse = list(range(phase, len(rows), fold))
    v = [value[i] for i in pulse]
    found = barring(v)
    if found is None:
        return (None, "refused", 0.0, fold, phase, None), []
    meter, line, high, margin = found
    checks = [barring(v[i : i + 4 * meter]) for i in range(0, len(v) - 4 * meter + 1, 4 * meter)]
    votes = [(m == meter and (4 * meter * k + p) % meter == line) for k, c in enumerate(checks) if c and c[2] > 0 for m, p in [c[:2]]]
    agreement = sum(votes) / len(votes) if len(votes) >= 2 else None
    score = 0.35 * min(high, 1) + 0.25 * min(margin / 0.5, 1)
    score = max(0.0, min(1.0, score / 0.6 if agreement is None else score + 0.4 * agreement))
    lines = sorted({0, *range(line, len(v), meter)})
    ok = score >= 0.3
    return (meter if ok else None, "inferred" if ok else "refused", round(score, 3), fold, phase, None if agreement is None else round(agreement, 3)), [pulse[k] for k in lines] if ok else []


def test_bar_map(spark, sf_dir):
    maps = {r.rec_id: r for r in QUERIES["i02_bar_map"](spark, sf_dir).collect()}
    bars = grouped(QUERIES["i02_bars"](spark, sf_dir), "rec_id", "bar")
    seen = set()
    for rec, rows in grouped(analysis_queries._salient(spark, sf_dir), "rec_id", "t").items():
        want, starts = bar_map(rows)
        m = maps[rec]
        assert (m.meter, m.source, m.fold, m.fold_phase) == (want[0], want[1], want[3], want[4]), (rec, m, want)
        assert abs(m.confidence - want[2]) < 2e-3 and (m.agreement is None) == (want[5] is None) and abs((m.agreement or 0) - (want[5] or 0)) < 2e-3
        assert [b.beat for b in bars.get(rec, [])] == [rows[i].beat for i in starts], rec
        assert [b.in_group for b in bars.get(rec, [])] == [k % 4 + 1 for k in range(len(starts))]
        seen.add((m.source, m.fold_reason))
    assert len(seen) >= 3


def test_bursts(spark, sf_dir):
    got = grouped(QUERIES["i06_bursts_over_baseline"](spark, sf_dir), "rec_id", "first")
    hits = grouped(analysis_queries.recordings(spark, sf_dir).where("event_type <> 'view'"), "rec_id", "t")
    for rec, beats in grouped(analysis_queries._numbered_grid(spark, sf_dir), "rec_id", "t").items():
        if len(beats) < 2:
            assert rec not in got
            continue
        t = [b.t for b in beats]
        edges = [*t, t[-1] + median(b - a for a, b in zip(t, t[1:]))]
        kinds = sorted({h.event_type for h in hits[rec] if edges[0] <= h.t < edges[-1]})
        count = [{k: sum(a <= h.t < b and h.event_type == k for h in hits[rec]) for k in kinds} for a, b in zip(edges, edges[1:])]
        density = [sum(c.values()) / (b - a) for c, a, b in zip(count, edges, edges[1:])]
        base, busy = median(density), []
        for i, c in enumerate(count):
            over = 0
            for k in kinds:
                around = [count[j][k] for j in range(max(0, i - 8), min(len(count), i + 9)) if abs(i - j) > 2]
                over += max(0, c[k] - (median(around) if around else 0))
            busy.append(base > 0 and (density[i] >= 1.6 * base and sum(c.values()) >= 3 or over >= 3))
        runs = []
        for i in [i for i, x in enumerate(busy) if x]:
            if runs and i - runs[-1][1] <= 2:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        want = []
        for a, b in [r for r in runs if r[1] - r[0] < 8]:
            total = {k: sum(c[k] for c in count[a : b + 1]) for k in kinds}
            n, length = sum(total.values()), edges[b + 1] - edges[a]
            kit = n - total.get("error", 0)
            into = beats[b + 1] if b + 1 < len(beats) else None
            factor = [
                min(max((n / length / base - 1) / 2, 0), 1), min(total.get("click", 0) / kit / 0.5, 1) if kit else 0,
                any(abs(h.t - edges[b + 1]) <= 0.25 * length / (b - a + 1) for h in hits[rec]), (1 if (into.bar - 1) % 4 == 0 else 0.6) if into and into.downbeat else 0.15,
            ]
            sure = sum(w * x for w, x in zip((0.35, 0.25, 0.15, 0.25), factor))
            if sure >= 0.2:
                want.append((a + 1, b - a + 1, n, sure))
        assert [(r.first, r.beats, r.hits) for r in got.get(rec, [])] == [w[:3] for w in want], rec
        assert all(abs(r.confidence - w[3]) < 2e-3 for r, w in zip(got.get(rec, []), want))


def test_phrases(spark, sf_dir):
    got = grouped(QUERIES["i07_phrase_boundaries"](spark, sf_dir), "rec_id", "rec_id")
    got = {k: sorted(v, key=lambda r: [r.measured, r.notes]) for k, v in got.items()}
    grids = grouped(analysis_queries._numbered_grid(spark, sf_dir), "rec_id", "t")
    for rec, rows in grouped(analysis_queries.recordings(spark, sf_dir), "rec_id", "t").items():
        grid = grids.get(rec, [])
        notes = [(r.t, r.t + r.value * 600, 80 + r.event_id % 7 * 40) for r in rows]
        if len(grid) < 2 or len(notes) < 2:
            assert rec not in got
            continue
        beat, usual = median(b.t - a.t for a, b in zip(grid, grid[1:])), median(n[1] - n[0] for n in notes)
        kept, want = 0, []
        for i, (start, end, hz) in enumerate(notes, 1):
            nxt = notes[i] if i < len(notes) else None
            rest = max(nxt[0] - end, 0) if nxt else None
            leap = abs(12 * math.log2(nxt[2] / hz)) if nxt else None
            if nxt and rest < 0.5 * beat and end - start < 1.6 * usual and leap < 7:
                continue
            after = next((g.t for g in grid if g.t >= end), None)
            near = min((g.t for g in grid), key=lambda t: (abs(t - end), t))
            called = after if after is not None and (nxt is None or after <= nxt[0]) else near if abs(near - end) <= beat else end
            row = next((g for g in reversed(grid) if g.t <= called), None)
            cues = sorted([1 if rest is None else min(rest / 2 / beat, 1), min(max(((end - start) / usual - 1) / 2, 0), 1), 0 if leap is None else min(leap / 12, 1)])
            line = (1 if (row.bar - 1) % 4 == 0 else 0.6) if row and row.downbeat else 0.15
            sure = round(min(0.55 * cues[2] + 0.1 * (cues[0] + cues[1]) + 0.25 * line, 1), 3)
            if sure < 0.35 or want and end - want[-1][1] < 2 * beat:
                continue
            want.append((called, end, i - kept, sure))
            kept = i
        rows, want = got.get(rec, []), sorted(want, key=lambda w: (round(w[1], 3), w[2]))
        assert [r.notes for r in rows] == [w[2] for w in want], rec
        assert all(abs(r.t - w[0]) < 2e-3 and abs(r.measured - w[1]) < 2e-3 and abs(r.confidence - w[3]) < 2e-3 for r, w in zip(rows, want))


def test_bar_map_of_an_empty_grid(spark):
    empty = spark.createDataFrame([], "rec_id int, t double, beat long, bar long, salience double")
    maps, bars = analyses.bar_map(empty, ["rec_id"])
    assert maps.collect() == [] and bars.collect() == []


def test_shared_steps_are_worked_out_once(spark, sf_dir):
    """What several parts of a plan read is a table in the shared folder, not a plan that each part runs again."""
    files = lambda name: QUERIES[name](spark, sf_dir).inputFiles()
    for name in ("i02_bar_map", "i02_bars", "i07_phrase_boundaries"):
        assert not any("events.parquet" in f for f in files(name)), name
    for name, table in (("i04_sections", "/settled-"), ("i08_correlate_all", "/items-"), ("d33_gap_report", "/gaps-")):
        assert any(table in f for f in files(name)), name
