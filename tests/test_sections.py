"""Sections, whole windows and verdicts on small frames whose values are worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import aggregates as A
from chronoframe.operators import windows as W
from chronoframe.plans import pipelines as P
from chronoframe.plans import sections as S

BY = ["k"]


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def set_of_three(spark):
    """Applause at 100-110 and 300-310 s of 500; talk for 20 s after the first, silence after the second."""
    curve = [("a", float(t), 0.9 if 100 <= t < 110 or 300 <= t < 310 else 0.0) for t in range(501)]
    level = [("a", float(t), -60.0 if 110 <= t < 130 or t >= 310 else -20.0) for t in range(0, 500, 2)]
    beats = [("a", t * 0.5) for t in range(0, 400)]  # until 200 s
    return frame(spark, "k string, t double, p double", curve), frame(spark, "k string, t double, level double", level), frame(spark, "k string, t double", beats)


def test_sections_start_where_the_music_does(spark):
    curve, level, beats = set_of_three(spark)
    got = S.sections(curve, level, beats, BY, "p").orderBy("stop").collect()
    assert [(r.start, r.stop, r.before, r.after, r.talk_seconds, r.outcome, r.beats, r.rate) for r in got] == [
        (0.0, 100.0, None, 10.0, 0.0, None, 200, 2.0), (130.0, 300.0, 10.0, 10.0, 20.0, None, 140, 0.824), (310.0, 500.0, 10.0, None, None, "silent", 0, 0.0),
    ]
    late = S.sections(curve, level, beats, BY, "p", density=1.0, minimum=95.0).orderBy("stop").collect()
    assert [r.outcome for r in late] == [None, "sparse", "silent"]
    brief = S.sections(curve, level, None, BY, "p", minimum=185.0).orderBy("stop").collect()
    assert [(r.start, r.outcome, r.beats) for r in brief] == [(130.0, "brief", None), (310.0, "silent", None)]


def test_unknown_is_not_silent(spark):
    curve, level, beats = set_of_three(spark)
    got = S.sections(curve, level.where("t < 100"), beats, BY, "p", hold=200.0).orderBy("stop").collect()
    assert [(r.start, r.talk_seconds, r.outcome) for r in got] == [(0.0, None, None), (110.0, None, None), (310.0, None, "sparse")]
    one = frame(spark, "k string, t double, p double", [("b", 5.0, 0.9)])
    assert S.sections(one, level, beats, BY, "p", minimum=0.0).select("start", "stop", "outcome").collect()[0][:2] == (5.0, 5.0)
    assert S.sections(curve.where("false"), level, beats, BY, "p").collect() == []


def test_a_recording_without_clear_bursts_reads_on_its_own_scale(spark):
    quiet = frame(spark, "k string, t double, p double", [("a", float(t), 0.3 if 100 <= t < 104 else 0.01) for t in range(300)])
    r = S.reading(quiet, BY, "p", 0.5, F.lit(0.09), 5.0).collect()[0]
    assert (round(r.threshold, 6), r.burst) == (0.027, 2.0)
    loud = frame(spark, "k string, t double, p double", [("a", float(t), 0.9 if t < 12 else 0.01) for t in range(300)])
    assert S.reading(loud, BY, "p", 0.5, F.lit(0.09), 5.0).collect()[0][1:] == (0.5, 5.0)


def test_sweep_is_the_sections_of_every_setting(spark):
    curve, level, beats = set_of_three(spark)
    truth = frame(spark, "k string, t double", [("a", 0.0), ("a", 131.0)])
    got = {(r.scale, r.margin, r.hold): r for r in S.sweep_sections(curve, level, beats, truth, BY, "p", [0.0, 0.09], [6.0, 50.0], [10.0, 400.0], 3.0).collect()}
    assert len(got) == 8
    for scale, margin, hold in ((0.09, 6.0, 10.0), (0.0, 50.0, 400.0)):
        r = got[scale, margin, hold]
        kept = [s.start for s in S.sections(curve, level, beats, BY, "p", scale=scale, margin=margin, hold=hold).where("outcome is null").collect()]
        matched = sum(any(abs(t - x) <= 3 for x in kept) for t in (0.0, 131.0))
        assert (r.truths, r.matched, r.invented) == (2, matched, sum(all(abs(t - x) > 3 for t in (0.0, 131.0)) for x in kept))
        assert r.clean == (matched == 2 and r.invented == 0)
    assert got[0.09, 6.0, 10.0].clean and not got[0.09, 50.0, 10.0].clean


@pytest.mark.parametrize("clips, lengths, want", [
    ("ABABABABABA", [4.0] * 11, True),  # strict alternation, one length
    ("AABBAABBAAB", [4.0] * 11, False),  # one length, no alternation
    ("ABABABABABA", [1, 30, 3, 90, 5, 12, 2, 40, 9, 70, 6], False),  # alternation of free lengths
    ("ABABABABABA", [90, 70, 50, 35, 25, 16, 12, 7, 5, 3, 1], True),  # alternation on a ladder
    ("A", [4.0], False),
])
def test_rhythm(spark, clips, lengths, want):
    starts = np.cumsum([0, *lengths])
    df = frame(spark, "k string, t double, seconds double, clip string", [("a", float(t), 3600.0 * s, c) for t, s, c in zip(starts, lengths, clips)])
    assert P.rhythm(df, BY).collect()[0].metronomic == want


def test_whole_windows(spark):
    df = frame(spark, "k string, t double, v double", [("a", 100.0 + t, 1.0) for t in range(11)] + [("b", 5.0, 2.0), ("b", 6.0, 2.0)] + [("c", 1.0, 3.0)])
    got = {(r.k, r.start): (r.n, r.span) for r in W.hopping_windows(df, BY, 4.0, 3.0).groupBy("k", "start").agg(F.count("*").alias("n"), F.first("span").alias("span")).collect()}
    assert got == {("a", 100.0): (4, 4.0), ("a", 103.0): (4, 4.0), ("a", 106.0): (4, 4.0), ("b", 5.0): (2, 1.0), ("c", 1.0): (1, 0.0)}
    sparse = W.hopping_windows(df, BY, 1.0, 3.0).groupBy("k", "start").count().where("k = 'a'").collect()
    assert sorted((r.start, r["count"]) for r in sparse) == [(100.0, 1), (103.0, 1), (106.0, 1), (109.0, 1)]
    t = {(r.k, r.start): r for r in W.window_table(df, BY, 4.0, 3.0, [F.col("v")], F.col("v"), F.lit(True)).collect()}
    assert (t["a", 103.0].lufs, t["a", 103.0].rms, t["a", 103.0].onsets) == (-0.69, 0.0, 1.0) and t["b", 5.0].onsets == 2.0 and t["c", 1.0].onsets is None


def test_levelled_head(spark):
    v = [float(x) for x in np.random.default_rng(0).integers(0, 50, 60)]
    for n, width in ((60, 33), (60, 4), (20, 33), (10, 33), (1, 33)):
        df = frame(spark, "k string, t double, v double", [("a", float(i), x) for i, x in enumerate(v[:n])])
        got = [r.levelled for r in W.levelled(df, BY, "v", width).orderBy("t").collect()]
        m = [float(np.median(v[:n][max(0, i - width // 2) :][:width])) for i in range(n)]
        assert got == [x / y if y > 0 else 0.0 for x, y in zip(v, m)], (n, width)


def test_best_window(spark):
    one = lambda *ts: frame(spark, "k string, t double", [("a", float(t)) for t in ts])
    levels = frame(spark, "k string, t double, level double", [("a", 0.0, -20.0), ("a", 30.0, -8.0), ("a", 31.0, -14.0), ("a", 60.0, -8.0)])
    spans = frame(spark, "k string, lo double, hi double", [("a", 0.0, 60.0), ("b", 0.0, 60.0), ("c", 0.0, 5.0)])
    got = {r.k: tuple(r)[1:] for r in W.best_window(spans, one(45.0), one(46.0, 46.5), one(47.0), levels, BY, 20.0, 10.0).collect()}
    # 30-50 has the change, the events, the peak at 30 and a range of 6: 3 + 0.2 + 0.05 + 0.5 + 1
    assert got == {"a": (30.0, 1, 2, 1, 6.0, True, 4.75), "b": (0.0, 0, 0, 0, None, False, 0.0)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    recs = {"a": rng.normal(size=2000), "b": np.repeat([1.0, 1.0 + 1e-12, 5.0], 40), "c": np.array([7.0]), "d": np.concatenate([rng.normal(size=300), [1e12, -1e12]])}
    df = frame(spark, "k string, v double", [(k, float(x)) for k, v in recs.items() for x in v] + [("a", None), ("e", None)])
    for bins, rounds in ((4, 2), (1024, 3)):
        got = {r.k: r for r in A.exact_quantiles(df, BY, "v", {"low": 0.05, "mid": 0.5, "top": 1.0}, bins, rounds).collect()}
        for k, v in recs.items():
            assert (got[k].low, got[k].mid, got[k].top) == pytest.approx(tuple(np.percentile(v, [5, 50, 100])), rel=1e-12, abs=1e-9), k
        assert (got["e"].low, got["e"].mid) == (None, None)


def test_exact_quantiles_of_few_and_many(spark):
    """Keys on both sides of the limit give the same kind of row; small ones are not dealt to bins."""
    recs = {"a": np.arange(60.0) ** 2, "b": np.array([3.0, 1.0]), "c": np.arange(50.0)}
    df = frame(spark, "k string, v double", [(k, float(x)) for k, v in recs.items() for x in v] + [("e", None)])
    got = {r.k: (r.low, r.mid) for r in A.exact_quantiles(df, BY, "v", {"low": 0.05, "mid": 0.5}, 4, 2, many=50).collect()}
    assert got.pop("e") == (None, None)
    assert got == {k: pytest.approx(tuple(np.percentile(v, [5, 50]))) for k, v in recs.items()}


def test_gear_verdict(spark):
    levels = frame(spark, "k string, t double, level double", [("a", float(t), float(t)) for t in range(0, 12)])
    items = frame(spark, "k string, t double, seconds double", [("a", t, 1.0) for t in (0.0, 4.0, 8.0, 8.5, 9.0, 11.5, 12.0, 13.0)])
    r = P.gear_verdict(items, levels, BY, 1.0, 2.0).collect()[0]
    # windows 0-11 touch the cut, four quiet with one item, four loud with four; two items lie beyond the curve
    assert (r.outside, r.loud, r.quiet, r.ratio, r.short, r.short_loud, r.short_share, r.one_speed) == (2, 60.0, 15.0, 4.0, 6, 4, 0.6667, False)
