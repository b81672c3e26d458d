"""SQL of the analyses that are built from other queries: it is built from theirs."""

from __future__ import annotations

from .registry import CTES, ORACLES, sql
from .aggregate_queries import _BIN, _BINS
from .window_queries import _MERGE, _RUN


def _bursts(threshold: float, gap: float, least: float) -> str:
    """Common table expression mm, then b: runs over the threshold, merged over gaps, of some length."""
    return f"{_RUN.replace('value >= 20', f'value >= {threshold}')}, {_MERGE.replace('7200', str(gap))}, b AS (SELECT * FROM mm WHERE stop - start >= {least})"


ORACLES["i01_grid_trust"] = f"""WITH st AS ({ORACLES["e02_steady_flags"]}), sz AS ({ORACLES["d14_modal_size"]}),
p AS (SELECT user_id AS rec_id, event_id, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 1e6 / 86400) ORDER BY ts) AS pos FROM events),
r AS (SELECT event_id, pos, steady, concat_ws(',', CASE WHEN size < 2 OR pos > size THEN 'bar_position' END, CASE WHEN NOT steady THEN 'tempo' END) AS refused FROM p JOIN st USING (event_id) JOIN sz USING (rec_id))
SELECT *, refused = '' AS trusted FROM r"""

_ALTERNATION = ORACLES["e08_alternation_run"].replace(f"WITH {CTES['e']},", f"WITH {CTES['e']}, {CTES['items'].replace('event_type AS clip', 'event_type')},").replace("FROM e WINDOW", "FROM items WINDOW").replace("FROM e GROUP BY 1)", "FROM items GROUP BY 1)")
_MONOTONE = ORACLES["e09_monotone_run"].replace(f"WITH {CTES['e']},", f"WITH {CTES['e']}, {CTES['items']},").replace("sign(value - lag(value) OVER w) AS s FROM e", "sign(seconds - lag(seconds) OVER w) AS s FROM items")
ORACLES["i10_rhythm"] = sql(
    f"""+al AS ({_ALTERNATION}), mo AS ({_MONOTONE}), u AS ({ORACLES["d08_uniformity"]}),
    c AS (SELECT rec_id, CASE WHEN count(*) > 1 THEN round(stddev_pop(seconds) / avg(seconds), 4) END AS cv, count(*) AS n FROM items GROUP BY 1)
    SELECT c.rec_id, c.cv, n, al.run AS alternation, al.share AS alternation_share, mo.run AS monotone, fullest, u.share AS fullest_share, CASE WHEN n > 1 THEN round(mo.run / (n - 1), 4) ELSE 0 END AS ramp_share,
           coalesce(al.share > 0.8, FALSE) AND (coalesce(u.share > 0.6, FALSE) OR coalesce(c.cv < 0.35, FALSE) OR n > 1 AND round(mo.run / (n - 1), 4) > 0.6) AS metronomic
    FROM c JOIN al USING (rec_id) JOIN mo USING (rec_id) JOIN u USING (rec_id)""",
    "e",
    "items",
)

ORACLES["i11_gears"] = sql(
    """+w AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY level, t) - 1 AS r, count(*) OVER (PARTITION BY rec_id) AS n, coalesce(lead(t) OVER o - t, t - lag(t) OVER o, 0) AS step, coalesce(lead(t) OVER o, t + 3600) AS stop
          FROM level WINDOW o AS (PARTITION BY rec_id ORDER BY t)),
    t AS (SELECT *, CASE WHEN r < n // 3 THEN 'quiet' WHEN r >= 2 * n // 3 THEN 'loud' ELSE 'middle' END AS tercile FROM w),
    s AS (SELECT rec_id, tercile, sum(least(step, 3600)) AS s FROM t GROUP BY ALL),
    h AS (SELECT t.rec_id, tercile, count(*) AS n, count(*) FILTER (WHERE seconds < 3600) AS short FROM items i JOIN t ON t.rec_id = i.rec_id AND t.t <= i.t AND i.t < t.stop GROUP BY ALL)
    SELECT s.rec_id, s.tercile, coalesce(n, 0) AS n, coalesce(short, 0) AS short, CASE WHEN s > 0 THEN round(3600 * coalesce(n, 0) / s, 4) END AS rate FROM s LEFT JOIN h ON h.rec_id = s.rec_id AND h.tercile = s.tercile""",
    "e",
    "items",
    "level",
)

ORACLES["i13_quality_catalog"] = sql(
    f"""+m AS ({ORACLES["b21_floor_misses"]}), x AS (SELECT e.*, m.misses, m.severity AS sev, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS i FROM e JOIN m USING (event_id)),
    g AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY rec_id ORDER BY i) > 2, TRUE)::INT AS nw FROM x WHERE misses <> ''), h AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id ORDER BY i) AS g FROM g)
    SELECT rec_id, min(i) AS first, max(i) + 1 AS "end", count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(string_split(misses, ','))))), ',') AS reasons, round(max(sev), 6) AS severity FROM h GROUP BY rec_id, g""",
    "e",
)

ORACLES["i04_quiet_sections"] = sql(
    f"""+{_bursts(30, 7200, 60)}, tt AS (SELECT rec_id, min(t) AS first, max(t) AS last FROM e GROUP BY 1),
    q AS (SELECT b.*, first, last, lag(stop) OVER w AS p, lead(start) OVER w AS nx FROM b JOIN tt USING (rec_id) WINDOW w AS (PARTITION BY rec_id ORDER BY start)),
    s AS (SELECT rec_id, coalesce(p, first) AS start, start AS stop FROM q UNION ALL SELECT rec_id, stop, last FROM q WHERE nx IS NULL),
    k AS (SELECT s.*, (SELECT count(*) FROM e c WHERE c.rec_id = s.rec_id AND c.event_type = 'click' AND c.t >= s.start AND c.t < s.stop) AS n FROM s WHERE stop >= start)
    SELECT rec_id, start, stop, n, CASE WHEN stop - start < 3600 THEN 'brief' WHEN (CASE WHEN stop > start THEN n / (stop - start) ELSE 0 END) < 1e-6 THEN 'sparse' END AS reason FROM k""",
    "e",
)

ORACLES["i11_gear_verdict"] = sql(
    """+b AS (SELECT rec_id, min(t) AS a, max(t + seconds) AS z, CASE WHEN count(*) > 1 THEN round(stddev_pop(seconds) / avg(seconds), 4) END AS cv FROM items GROUP BY 1),
    w AS (SELECT l.rec_id, l.t, row_number() OVER (PARTITION BY l.rec_id ORDER BY level, l.t) - 1 AS r, count(*) OVER (PARTITION BY l.rec_id) AS n, coalesce(lead(l.t) OVER (PARTITION BY l.rec_id ORDER BY l.t), l.t + 3600) AS stop FROM level l JOIN b USING (rec_id) WHERE l.t < z AND l.t + 3600 > a),
    g AS (SELECT rec_id, t, stop, CASE WHEN r < n // 3 THEN 'quiet' WHEN r >= 2 * n // 3 THEN 'loud' ELSE 'middle' END AS g FROM w),
    s AS (SELECT rec_id, count(*) FILTER (WHERE g = 'loud') AS wl, count(*) FILTER (WHERE g = 'quiet') AS wq FROM g GROUP BY 1),
    h AS (SELECT i.rec_id, i.seconds, g.g FROM items i LEFT JOIN g ON g.rec_id = i.rec_id AND g.t <= i.t AND i.t < g.stop),
    n AS (SELECT rec_id, count(*) FILTER (WHERE g IS NULL) AS outside, count(*) FILTER (WHERE g = 'loud') AS nl, count(*) FILTER (WHERE g = 'quiet') AS nq, count(*) FILTER (WHERE g IS NOT NULL AND seconds < 7200) AS short, count(*) FILTER (WHERE g = 'loud' AND seconds < 7200) AS short_loud FROM h GROUP BY 1),
    r AS (SELECT n.*, cv, CASE WHEN wl > 0 THEN round(nl / (wl * 3600::DOUBLE / 60), 4) END AS loud, CASE WHEN wq > 0 THEN round(nq / (wq * 3600::DOUBLE / 60), 4) END AS quiet FROM n JOIN s USING (rec_id) JOIN b USING (rec_id)),
    q AS (SELECT *, CASE WHEN quiet > 0 THEN round(loud / quiet, 4) END AS ratio FROM r)
    SELECT rec_id, outside, loud, quiet, ratio, short, short_loud, CASE WHEN short > 0 THEN round(short_loud / short, 4) END AS short_share, coalesce(ratio < 1.3 AND cv < 0.65, FALSE) AS one_speed FROM q""",
    "e",
    "items",
    "level",
)

ORACLES["i13_quality_header"] = f"WITH d AS ({ORACLES['d11_stretch_summary']}), n AS (SELECT user_id AS rec_id, count(*) AS samples FROM events GROUP BY 1) SELECT d.*, samples, round(failed / samples, 4) AS unusable_share FROM d JOIN n USING (rec_id)"

ORACLES["i17_segment_histogram"] = f"WITH s AS (SELECT rec_id, (stop - start) / 3600 AS h FROM ({ORACLES['f15_segments_from_cuts']})), b AS (SELECT rec_id, {_BIN} AS bin FROM s), k AS (SELECT rec_id, o.bin FROM (SELECT DISTINCT rec_id FROM s), {_BINS} o) SELECT k.rec_id, k.bin, count(b.bin) AS n FROM k LEFT JOIN b ON b.rec_id = k.rec_id AND b.bin = k.bin GROUP BY ALL"

ORACLES["d33_gap_report"] = sql(
    """+g AS (SELECT rec_id, t, lead(t) OVER (PARTITION BY rec_id ORDER BY t) - t AS gap FROM e), h AS (SELECT *, median(gap) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS m, row_number() OVER (PARTITION BY rec_id ORDER BY gap DESC, t) AS k FROM g WHERE gap IS NOT NULL)
    SELECT rec_id, count(*) AS gaps, round(avg(gap), 4) AS mean, round(median(gap), 4) AS median, round(quantile_cont(gap, 0.05), 4) AS p05, round(quantile_cont(gap, 0.95), 4) AS p95, round(min(gap), 4) AS least, round(max(gap), 4) AS most, count(*) FILTER (WHERE gap > 172800) AS wide,
           round(avg((abs(gap - m) <= 0.1::DOUBLE * m)::INT), 4) AS steady_share, array_to_string(list(floor(round(t, 2))::BIGINT || ':' || floor(round(gap, 2))::BIGINT ORDER BY k) FILTER (WHERE k <= 15), ',') AS largest FROM h GROUP BY 1""",
    "e",
)


_VIEWS = ORACLES["i01_grid_trust"].replace("FROM events", "FROM (SELECT * FROM events WHERE event_type = 'view')")
_CHANGE = "ch AS (SELECT rec_id, t, lag(event_id::VARCHAR) OVER (PARTITION BY rec_id ORDER BY t) AS was, event_id::VARCHAR AS \"to\" FROM e WHERE event_type = 'purchase')"


def _nearest(table: str, column: str) -> str:
    return f"(SELECT x.{column} FROM {table} x WHERE x.rec_id = i.rec_id ORDER BY abs(x.t - i.t), x.t LIMIT 1)"


#: Every item against every side, each looked up by itself; then a, the rows of correlate_all.
_ALL = f"""+tr AS ({_VIEWS}), gr AS (SELECT e.rec_id, e.t, trusted, lead(e.t) OVER (PARTITION BY e.rec_id ORDER BY e.t) - e.t AS gap FROM e JOIN tr USING (event_id)),
    gw AS (SELECT rec_id, t, trusted, quantile_cont(gap, 0.5) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS wide FROM gr),
    br AS (SELECT rec_id, t, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS bar FROM e WHERE event_type = 'purchase'), {_CHANGE}, ck AS (SELECT * FROM e WHERE event_type = 'click'),
    pc AS (SELECT rec_id, t, CASE WHEN event_id % 5 <> 0 THEN value / 100 END AS delta, CASE WHEN event_id % 5 <> 0 THEN value < 20 END AS jump FROM e WHERE event_type = 'error'),
    su AS (SELECT rec_id, t AS start, t + 40000 AS stop, CASE WHEN clip = 'view' THEN 'card' ELSE 'overlay' END AS kind FROM items WHERE value > 60),
    st AS (SELECT i.rec_id, i.event_id, arg_min(kind, (kind <> 'card', su.start, kind)) AS kind FROM items i JOIN su ON su.rec_id = i.rec_id AND su.start + 60 < i.t AND i.t < su.stop - 60 GROUP BY ALL),
    qu AS (SELECT i.rec_id, i.event_id, count(*) AS n, median(s.value) AS sh, median(s.value / 2) AS ex, max(s.value / 1000) AS cl, min(CASE WHEN s.event_type <> 'view' THEN s.value / 100 END) AS sb FROM items i JOIN e s ON s.rec_id = i.rec_id AND s.t >= i.t AND s.t < i.t + i.seconds GROUP BY ALL),
    sn AS (SELECT rec_id, t AS start, coalesce(lead(t) OVER (PARTITION BY rec_id ORDER BY t), 'infinity'::DOUBLE) AS stop, "to" AS label FROM ch),
    ov AS (SELECT i.rec_id, i.event_id, label, round(sum(least(i.t + i.seconds, stop) - greatest(i.t, start)), 3) AS s, min(greatest(i.t, start)) AS f FROM items i JOIN sn ON sn.rec_id = i.rec_id AND i.t < stop AND start < i.t + i.seconds GROUP BY ALL),
    mo AS (SELECT rec_id, event_id, label FROM ov QUALIFY row_number() OVER (PARTITION BY rec_id, event_id ORDER BY s DESC, f, label) = 1),
    nr AS (SELECT i.*, {_nearest("gw", "t")} AS gt, {_nearest("gw", "wide")} AS wide, {_nearest("gw", "trusted")} AS trusted, {_nearest("br", "t")} AS bt, {_nearest("br", "bar")} AS map_bar, {_nearest("ck", "t")} AS ct,
           {_nearest("pc", "t")} AS pt, {_nearest("pc", "delta")} AS delta, {_nearest("pc", "jump")} AS jump, coalesce(lag(t + seconds) OVER (PARTITION BY rec_id ORDER BY t) <> t, TRUE) AS opens,
           (SELECT "to" FROM ch WHERE ch.rec_id = i.rec_id AND ch.t <= i.t ORDER BY ch.t DESC LIMIT 1) AS state, (SELECT section FROM sections s WHERE s.rec_id = i.rec_id AND s.start <= i.t AND (s.stop IS NULL OR i.t < s.stop)) AS section FROM items i),
    a AS (SELECT nr.rec_id, nr.event_id, t - gt AS "offset", t - bt AS bar_offset, t - ct AS transient_offset, CASE WHEN abs(t - pt) <= 20000 THEN delta END AS delta, CASE WHEN abs(t - pt) <= 20000 THEN jump END AS jump, opens, coalesce(wide > 0 AND abs(t - gt) > wide, FALSE) AS stranded,
           coalesce(trusted, FALSE) AND NOT coalesce(wide > 0 AND abs(t - gt) > wide, FALSE) AS in_grid, map_bar, (map_bar - 1) % 4 + 1 AS in_group, section, state, kind IS NOT NULL AS straddles, kind AS super_kind, sh AS sharpness, ex AS exposure, cl AS clipped, sb AS stability, coalesce(n, 0) AS samples, label AS most
          FROM nr LEFT JOIN st USING (rec_id, event_id) LEFT JOIN qu USING (rec_id, event_id) LEFT JOIN mo USING (rec_id, event_id)) """
ORACLES["i08_correlate_all"] = sql(
    _ALL + """SELECT event_id, round("offset", 3) AS "offset", round(bar_offset, 3) AS bar_offset, round(transient_offset, 3) AS transient_offset, round(delta, 6) AS delta, round(sharpness, 6) AS sharpness, round(exposure, 6) AS exposure, round(clipped, 6) AS clipped, round(stability, 6) AS stability,
           opens, stranded, in_grid, map_bar, in_group, section, state, jump, straddles, super_kind, samples, most FROM a""",
    "e", "items", "sections",
)
ORACLES["i09_correlate_all_summary"] = sql(
    _ALL + """, o AS (SELECT *, CASE WHEN NOT opens AND in_grid THEN round("offset", 3) END AS o, CASE WHEN NOT opens THEN round(bar_offset, 3) END AS b FROM a)
    SELECT rec_id, count(*) AS items, count(o) AS measured, round(sum(abs(o)), 3) AS total, round(median(abs(o)), 9) AS median, count(*) FILTER (WHERE o < 0) AS early, count(*) FILTER (WHERE opens) AS openings, count(*) FILTER (WHERE NOT opens AND NOT in_grid AND NOT stranded) AS gated,
           count(*) FILTER (WHERE NOT opens AND stranded) AS stranded, round(sum(abs(b)), 3) AS bar_total, count(*) FILTER (WHERE NOT opens AND in_group = 1) AS on_group, count(*) FILTER (WHERE section IS NULL) AS outside, count(*) FILTER (WHERE delta IS NULL) AS unread,
           count(*) FILTER (WHERE straddles) AS straddles, count(*) FILTER (WHERE samples = 0) AS unsampled FROM o GROUP BY 1""",
    "e", "items", "sections",
)


def _sections(settings: list[tuple[float, float, float]]) -> str:
    """Common table expressions up to x: the calls of every (scale, margin, hold), settled and sifted, step by step."""
    key = "rec_id, scale, margin, hold"
    same = " AND ".join(f"b.{k} = a.{k}" for k in ("rec_id", "scale", "margin", "hold", "start"))
    return f"""st(scale, margin, hold) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in settings)}),
    sp AS (SELECT *, coalesce(lead(t) OVER w - t, t - lag(t) OVER w, 0) AS step FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY t)),
    ov AS (SELECT rec_id, sum(CASE WHEN value >= 60 THEN step ELSE 0 END) AS o, count(*) AS n FROM sp GROUP BY 1),
    hl AS (SELECT rec_id, coalesce(max(value) FILTER (WHERE c >= 3600), min(value)) AS held FROM (SELECT a.rec_id, a.value, sum(b.step) AS c FROM (SELECT DISTINCT rec_id, value FROM sp) a JOIN sp b ON b.rec_id = a.rec_id AND b.value >= a.value GROUP BY a.rec_id, a.value) GROUP BY 1),
    rd AS (SELECT rec_id, scale, CASE WHEN scale <= 0 OR n < 2 OR o >= 200000 THEN 60 ELSE least(60, greatest(2, held * scale)) END AS thr, CASE WHEN scale <= 0 OR n < 2 OR o >= 200000 THEN 7200 ELSE 3600 END AS burst FROM ov JOIN hl USING (rec_id), (SELECT DISTINCT scale FROM st)),
    oo AS (SELECT sp.rec_id, scale, t, value >= thr AS up, burst, coalesce(lead(t) OVER w, 2 * t - lag(t) OVER w, t) AS stop, coalesce(lag(value >= thr) OVER w, FALSE) AS was FROM sp JOIN rd USING (rec_id) WINDOW w AS (PARTITION BY sp.rec_id, scale ORDER BY t)),
    gg AS (SELECT *, sum((up AND NOT was)::INT) OVER (PARTITION BY rec_id, scale ORDER BY t) AS g FROM oo), ru AS (SELECT rec_id, scale, min(t) AS start, max(stop) AS stop, any_value(burst) AS burst FROM gg WHERE up GROUP BY rec_id, scale, g),
    mm AS (SELECT *, coalesce(start - max(stop) OVER (PARTITION BY rec_id, scale ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 7200, TRUE)::INT AS nw FROM ru), mn AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id, scale ORDER BY start) AS g FROM mm),
    bu AS (SELECT rec_id, scale, min(start) AS start, max(stop) AS stop FROM mn GROUP BY rec_id, scale, g HAVING max(stop) - min(start) >= any_value(burst)),
    tt AS (SELECT rec_id, scale, min(t) AS a, max(t) AS z FROM e JOIN rd USING (rec_id) GROUP BY ALL),
    ed AS (SELECT rec_id, scale, coalesce(lag(stop) OVER w, a) AS start, start AS stop, lag(stop - start) OVER w AS before, stop - start AS after FROM bu JOIN tt USING (rec_id, scale) WINDOW w AS (PARTITION BY rec_id, scale ORDER BY start)
           UNION ALL SELECT rec_id, scale, max(stop), any_value(z), arg_max(stop - start, start), NULL FROM bu JOIN tt USING (rec_id, scale) GROUP BY ALL
           UNION ALL SELECT rec_id, scale, a, z, NULL, NULL FROM tt ANTI JOIN bu USING (rec_id, scale)),
    cs AS (SELECT rec_id, ed.scale, margin, hold, round(start, 3) AS start, round(stop, 3) AS stop, before, after FROM ed JOIN st ON st.scale = ed.scale WHERE stop >= start AND round(stop, 3) - round(start, 3) >= 36000),
    us AS (SELECT rec_id, median(value) AS usual FROM e GROUP BY 1),
    ii AS (SELECT cs.rec_id, scale, margin, hold, start, e.t, value >= usual - margin AS up, row_number() OVER w AS i, count(*) OVER (PARTITION BY cs.rec_id, scale, margin, hold, start) AS n, lead(e.t) OVER w - e.t AS gap FROM cs JOIN us ON us.rec_id = cs.rec_id JOIN e ON e.rec_id = cs.rec_id AND e.t >= start AND e.t < stop WINDOW w AS (PARTITION BY cs.rec_id, scale, margin, hold, start ORDER BY e.t)),
    wd AS (SELECT {key}, start, any_value(n) AS n, CASE WHEN median(gap) > 0 THEN greatest(round_even(hold / median(gap), 0)::BIGINT, 1) END AS w FROM ii GROUP BY {key}, start),
    hh AS (SELECT a.rec_id, a.scale, a.margin, a.hold, a.start, a.t, any_value(w) AS w, count(*) FILTER (WHERE b.up) AS c FROM ii a JOIN wd USING ({key}, start) JOIN ii b ON {same} AND b.i >= a.i AND b.i < a.i + w WHERE a.up AND a.i + w - 1 <= wd.n GROUP BY ALL),
    cm AS (SELECT {key}, start, round(min(t), 3) AS came FROM hh WHERE c >= 0.75 * w GROUP BY ALL),
    se AS (SELECT cs.*, came, coalesce(n >= 2 AND n >= w, FALSE) AND hold > 0 AS known FROM cs LEFT JOIN wd USING ({key}, start) LEFT JOIN cm USING ({key}, start)),
    mv AS (SELECT {key}, CASE WHEN known AND came IS NOT NULL THEN came ELSE start END AS start, stop, before, after, CASE WHEN known THEN round(came - start, 3) END AS talk_seconds, CASE WHEN NOT known THEN NULL WHEN came IS NULL THEN 'silent' WHEN stop - came < 36000 THEN 'brief' END AS outcome FROM se),
    bt AS (SELECT mv.*, (SELECT count(*) FROM e c WHERE c.rec_id = mv.rec_id AND c.event_type = 'click' AND c.t >= mv.start AND c.t < mv.stop) AS beats FROM mv),
    rt AS (SELECT *, CASE WHEN stop > start THEN round(beats / (stop - start), 6) ELSE 0 END AS rate FROM bt),
    x AS (SELECT * REPLACE (CASE WHEN outcome IS NULL AND rate < 0.000003 THEN 'sparse' ELSE outcome END AS outcome) FROM rt)"""


ORACLES["i04_sections"] = sql(f"+{_sections([(0.5, 3, 200000)])} SELECT rec_id, start, stop, before, after, talk_seconds, outcome, beats, rate FROM x", "e")
ORACLES["i20_sections_sweep"] = sql(
    f"""+{_sections([(a, b, c) for a in (0.3, 0.6) for b in (1, 5) for c in (100000, 300000)])}, f AS (SELECT rec_id, scale, margin, hold, start AS t FROM x WHERE outcome IS NULL), l AS (SELECT rec_id, scale, margin, hold, t FROM e, st WHERE event_type = 'error'),
    er AS (SELECT l.rec_id, l.scale, l.margin, l.hold, l.t, min(abs(f.t - l.t)) AS err FROM l LEFT JOIN f USING (rec_id, scale, margin, hold) GROUP BY ALL),
    iv AS (SELECT f.rec_id, f.scale, f.margin, f.hold, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.event_type = 'error' AND c.rec_id = f.rec_id AND abs(c.t - f.t) <= 36000)) AS invented FROM f GROUP BY ALL),
    sc AS (SELECT rec_id, scale, margin, hold, count(*) AS truths, count(*) FILTER (WHERE err <= 36000) AS matched, CASE WHEN count(*) = count(*) FILTER (WHERE err <= 36000) THEN round(max(err), 3) END AS worst FROM er GROUP BY ALL)
    SELECT sc.*, coalesce(invented, 0) AS invented, matched = truths AND coalesce(invented, 0) = 0 AS clean FROM sc LEFT JOIN iv USING (rec_id, scale, margin, hold)""",
    "e",
)

_SWEEP = " UNION ALL ".join(f"SELECT {t}.0::DOUBLE AS threshold, rec_id, start AS t FROM (WITH {_bursts(t, 7200, 60)} SELECT * FROM b)" for t in (10, 20, 40))
ORACLES["i20_threshold_sweep"] = sql(
    f"""+f AS ({_SWEEP}), th AS (SELECT unnest([10.0, 20.0, 40.0])::DOUBLE AS threshold), l AS (SELECT threshold, rec_id, t FROM e, th WHERE event_type = 'error'),
    x AS (SELECT threshold, rec_id, abs(t - (SELECT f.t FROM f WHERE f.rec_id = l.rec_id AND f.threshold = l.threshold ORDER BY abs(f.t - l.t), f.t LIMIT 1)) AS err FROM l),
    y AS (SELECT rec_id, threshold, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.rec_id = f.rec_id AND l.threshold = f.threshold AND abs(l.t - f.t) <= 36000)) AS invented FROM f GROUP BY ALL)
    SELECT x.rec_id, x.threshold, count(*) AS truths, count(*) FILTER (WHERE err <= 36000) AS matched, coalesce(any_value(invented), 0) AS invented, CASE WHEN count(*) = count(*) FILTER (WHERE err <= 36000) THEN round(max(err), 3) END AS worst
    FROM x LEFT JOIN y ON y.rec_id = x.rec_id AND y.threshold = x.threshold GROUP BY x.rec_id, x.threshold""",
    "e",
)

ORACLES["f23_moving_runs"] = sql(
    f"""+v AS (SELECT *, (value - 20) / 40 AS dx, value % 7 / 10 AS dy FROM e), {_RUN.replace('value >= 20', 'abs(dx) >= 1 OR abs(dy) >= 1').replace('FROM e WINDOW', 'FROM v WINDOW')}, {_MERGE.replace('7200', '3600')}
    SELECT mm.rec_id, mm.start, mm.stop, round(sum(dx), 6) AS net_x, round(sum(dy), 6) AS net_y FROM mm JOIN v ON v.rec_id = mm.rec_id AND v.t >= mm.start AND v.t < mm.stop WHERE mm.stop - mm.start >= 60 GROUP BY mm.rec_id, mm.start, mm.stop""",
    "e",
)

_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(lag(embedding) OVER w, lambda x: x::DOUBLE) AS a, list_transform(lead(embedding) OVER w, lambda x: x::DOUBLE) AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"
ORACLES["e34_flux"] = f"WITH {_VEC} SELECT vec_id, CASE WHEN a IS NOT NULL THEN round(list_sum(list_transform(list_zip(v, a), lambda p: greatest(p[1] - p[2], 0))) / (list_sum(v) + 1e-9), 4) END AS flux FROM v"
ORACLES["e33_blend_fit"] = f"""WITH {_VEC}, d AS (SELECT vec_id, list_transform(list_zip(b, a), lambda p: p[1] - p[2]) AS d, list_transform(list_zip(v, a), lambda p: p[1] - p[2]) AS m FROM v WHERE a IS NOT NULL AND b IS NOT NULL),
    s AS (SELECT vec_id, list_dot_product(m, d) AS md, list_dot_product(d, d) AS dd, list_dot_product(m, m) AS mm FROM d)
    SELECT v.vec_id, round(md / dd, 4) AS alpha, round(sqrt(greatest(mm - md / dd * md, 0)) / sqrt(mm), 4) AS residual FROM v LEFT JOIN s USING (vec_id)"""

#: Greedy picks, best first, as a recursion over the number picked.
_GREEDY = """p AS (SELECT rec_id, 0 AS rank, []::DOUBLE[] AS ts, NULL::BIGINT AS event_id FROM s GROUP BY 1 UNION ALL
    (SELECT p.rec_id, p.rank + 1, list_append(p.ts, s.t), s.event_id FROM p JOIN s ON s.rec_id = p.rec_id AND len(list_filter(p.ts, lambda x: abs(x - s.t) < 86400)) = 0 WHERE p.rank < 5
     QUALIFY row_number() OVER (PARTITION BY p.rec_id ORDER BY s.score DESC, s.t, s.event_id) = 1)) SELECT rec_id, rank, event_id FROM p WHERE rank > 0"""
ORACLES["g04_spaced_top_k"] = sql(f"+s AS (SELECT rec_id, t, event_id, value AS score FROM e), {_GREEDY}", "e").replace("WITH", "WITH RECURSIVE", 1)
ORACLES["i19_event_rank"] = sql(
    f"""+s AS (SELECT rec_id, t, event_id, round(value / 100 + least(0.2 * (SELECT count(DISTINCT o.event_type) FROM e o WHERE o.rec_id = e.rec_id AND abs(round(o.t * 1000000)::BIGINT - round(e.t * 1000000)::BIGINT) <= 21600000000 AND o.event_type <> e.event_type), 0.4), 6) AS score FROM e), {_GREEDY}""",
    "e",
).replace("WITH", "WITH RECURSIVE", 1)
