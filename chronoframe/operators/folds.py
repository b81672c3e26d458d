"""Ordered folds over one recording by many tasks.

A recording is cut into chunks of its order. Each chunk is folded into a map from every state the fold may enter it
with to the state it leaves with; the maps of a recording, a few numbers each, are followed from its first chunk on;
then each chunk is run again from the state found, now giving its rows. The rows are those of one fold over all.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row has another key than the one before it; the first has."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in keys:
        v = table[c].combine_chunks()
        a, b = v.slice(1), v.slice(0, max(len(v) - 1, 0))
        other = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(v.type):
            other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        new[1:] |= pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return new


def _values(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_floating(column.type) or column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)):
        return column.to_numpy()
    found = np.empty(len(column), object)
    found[:] = column.to_pylist()
    return found


def in_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable, out: str, carry: bool = False) -> DataFrame:
    """The rows of `out` that fold() gives, as tuples, for each group of `keys`. It takes the other columns of a group as arrays, in
    order. Tasks take many groups, sorted, one after the other, so that small groups cost little more than their rows; keys may
    be null. With `carry` a group comes in pieces and is never held whole: fold(columns, state) gives rows and the next state,
    None at first."""
    made = StructType.fromDDL(out)
    schema = StructType([*(df.schema[c] for c in keys), *made])
    rest = [c for c in df.columns if c not in keys]
    kinds = to_arrow_schema(made)

    def emit(table: pa.Table, new: np.ndarray, state=None) -> tuple[pa.RecordBatch, object]:
        columns = {c: _values(table[c]) for c in rest}
        edges = np.flatnonzero(np.append(new, True)).tolist()
        if edges[0] > 0:
            edges.insert(0, 0)
        rows, at = [], []
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            group = {c: v[a:b] for c, v in columns.items()}
            if carry:
                found, state = fold(group, state if k == 0 and not new[0] else None)
            else:
                found = fold(group)
            n = len(rows)
            rows.extend(found)
            at.extend([a] * (len(rows) - n))
        parts = [table[c].combine_chunks().take(pa.array(at, pa.int64())) for c in keys]
        parts += [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(parts, names=schema.names), state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if carry:
                table = pa.Table.from_batches([*held, batch])
                new = _starts(table, keys)[len(held) :]
                found, state = emit(table.slice(len(held)), new, state)
                held = [batch.slice(batch.num_rows - 1)]
                yield found
                continue
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            cut = np.flatnonzero(_starts(pa.Table.from_batches([*before, batch]), keys)[1:]) + (0 if before else 1)
            if len(cut):
                table = pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))])
                yield emit(table, _starts(table, keys))[0]
                held = [batch.slice(int(cut[-1]))]
            else:
                held.append(batch)
        if held and not carry:
            table = pa.Table.from_batches(held)
            yield emit(table, _starts(table, keys))[0]

    # by a hash of its own: a shuffle by the keys themselves may go where a join before has one, and that one may be read anyhow
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold_in_chunks(df: DataFrame, by: list[str], order: list[str], chunk: Column, machine, out: str) -> DataFrame:
    """machine.summary(rows) is a chunk's map, machine.follow(map, state) the state after it (state None: before the first
    row), machine.run(rows, state, last) yields rows of the columns `out`; rows come as arrays by column, in order. chunk must not
    fall along the order. Keys of `by` may be null; a recording without rows gives none."""
    rows = df.withColumn("_c", chunk)
    key = [*by, "_c"]

    def follow(group: dict) -> list[tuple]:
        found, state = [], None
        for c, packed in zip(group["_c"].tolist(), group["map"], strict=True):
            found.append((c, pickle.dumps(state), c == group["_c"][-1]))
            state = machine.follow(pickle.loads(packed), state)
        return found

    def run(group: dict) -> Iterator[tuple]:
        # the state comes as a row of its own before the others
        return machine.run({c: v[1:] for c, v in group.items()}, pickle.loads(group["_state"][0]), bool(group["_last"][0]))

    maps = in_groups(rows, key, order, lambda g: [(pickle.dumps(machine.summary(g)),)], "map binary")
    entered = in_groups(maps, by, ["_c"], follow, "_c long, _state binary, _last boolean")
    both = entered.unionByName(rows, allowMissingColumns=True).withColumn("_row", F.col("_state").isNull())
    return in_groups(both, key, ["_row", *order], run, out).drop("_c")


def by_time(column: str, seconds: float | None) -> Column:
    """Chunks of so many seconds; None: one for all."""
    return (F.floor(F.col(column) / seconds) if seconds else F.lit(0)).cast("long")


class Spacing:
    """Greedy spacing in order: a row stays if its place is `gap` or more after that of the last row that stayed. Gives the
    value column of the rows that stay. The state is the place of the last one.

    The map of a chunk has the rows an earlier one can leave first: those whose place is higher than all before them, up to
    the first that is free even of the chunk's highest start; each with the place its chain of jumps leaves at."""

    def __init__(self, place: str, gap: float, value: str):
        self.place, self.gap, self.value = place, gap, value

    def jump(self, p: np.ndarray, rising: bool, last: float, low: int) -> int:
        """The first row from `low` on that is free of `last`; the number of rows if there is none."""
        if rising:
            j = max(low, int(np.searchsorted(p, last + self.gap)))
            while j > low and p[j - 1] - last >= self.gap:  # the sum may be off by its rounding
                j -= 1
            while j < len(p) and p[j] - last < self.gap:
                j += 1
            return j
        for a in range(low, len(p), 1024):
            if len(hit := np.flatnonzero(p[a : a + 1024] - last >= self.gap)):
                return a + int(hit[0])
        return len(p)

    def summary(self, rows: dict) -> tuple:
        p = np.asarray(rows[self.place], float)
        rising = bool((np.diff(p) >= 0).all())
        high = np.maximum.accumulate(p)
        first = np.flatnonzero(np.diff(high, prepend=-np.inf) > 0)
        if rising:  # what was left before the chunk lies before its first row
            first = first[: 1 + int(np.searchsorted(first, self.jump(p, True, p[0], 0)))]
        leaves: dict[int, float] = {}
        for j in first.tolist():
            chain = []
            while j < len(p) and j not in leaves:
                chain.append(j)
                j = self.jump(p, rising, p[j], j + 1)
            end = leaves[j] if j < len(p) else float(p[chain[-1]])
            leaves.update(dict.fromkeys(chain, end))
        ends = np.array([leaves[j] for j in first.tolist()])
        edge = np.append(np.diff(ends) != 0, True)  # of rows that leave alike the last
        return p[first][edge], ends[edge]

    def follow(self, made: tuple, last: float | None) -> float:
        places, ends = made
        if last is None:
            return float(ends[0])
        j = self.jump(places, True, last, 0)
        return float(ends[j]) if j < len(ends) else last

    def run(self, rows: dict, last: float | None, _: bool) -> Iterator[tuple]:
        p, values = np.asarray(rows[self.place], float), rows[self.value].tolist()
        rising = bool((np.diff(p) >= 0).all())
        j = 0 if last is None else self.jump(p, rising, last, 0)
        while j < len(p):
            yield (values[j],)
            j = self.jump(p, rising, p[j], j + 1)


class Covers:
    """Greedy cover in order of start: an item stays if it starts at or after the stop of the last that stayed, or is an empty
    one at its start. The state is (start, stop) of the last one."""

    def __init__(self, start: str, stop: str, value: str):
        self.start, self.stop, self.value = start, stop, value

    @staticmethod
    def jump(a: np.ndarray, b: np.ndarray, last: tuple, low: int) -> int:
        free = max(low, int(np.searchsorted(a, last[1])))
        while low < free and a[low] <= last[0]:
            if b[low] <= last[0]:
                return low
            low += 1
        return free

    def _spans(self, rows: dict) -> tuple[np.ndarray, np.ndarray]:
        a = np.asarray(rows[self.start], float)
        return a, np.maximum(a, np.asarray(rows[self.stop], float))

    def summary(self, rows: dict) -> tuple:
        a, b = self._spans(rows)
        leaves: dict[int, tuple] = {}
        first = np.flatnonzero(np.diff(a, prepend=-np.inf) > 0)
        for j in first.tolist():
            chain = []
            while j < len(a) and j not in leaves:
                chain.append(j)
                j = self.jump(a, b, (a[j], b[j]), j + 1)
            end = leaves[j] if j < len(a) else (float(a[chain[-1]]), float(b[chain[-1]]))
            leaves.update(dict.fromkeys(chain, end))
        ends = [leaves[j] for j in first.tolist()]
        keep = [k for k in range(len(ends)) if k + 1 == len(ends) or ends[k] != ends[k + 1]]
        return a[first][keep], [ends[k] for k in keep]

    def follow(self, made: tuple, last: tuple | None) -> tuple:
        j = 0 if last is None else int(np.searchsorted(made[0], last[1]))
        return made[1][j] if j < len(made[1]) else last

    def run(self, rows: dict, last: tuple | None, _: bool) -> Iterator[tuple]:
        a, b = self._spans(rows)
        values = rows[self.value].tolist()
        j = 0 if last is None else self.jump(a, b, last, 0)
        while j < len(a):
            yield (values[j],)
            j = self.jump(a, b, (a[j], b[j]), j + 1)


class ZigZag:
    """Legs of a level that turn once it comes back by `step` from its extreme: (t_from, v_from, t_to, v_to).

    The state is (way, start of the leg, highest and lowest row since), rows being (t, v); way is 0 until the first turn.
    After a turn only the row where it shows counts, so a chunk's map needs, for each way, the first turn by its own rows
    and, before that, its rows that are lower (higher) than all before them: an extreme brought along turns at the first
    of these that is `step` away from it."""

    def __init__(self, t: str, level: str, step: float):
        self.t, self.level, self.step = t, level, step

    def _turn(self, v: np.ndarray, low: int, way: int) -> int:
        """The first row from `low` on that is `step` back from the extreme since `low`."""
        best = np.maximum.accumulate(way * v[low:])
        hit = np.flatnonzero(best - way * v[low:] >= self.step)
        return low + int(hit[0]) if len(hit) else len(v)

    def _extreme(self, v: np.ndarray, a: int, b: int, way: int) -> int:
        return a + int((way * v[a:b]).argmax())

    def _from(self, t: np.ndarray, v: np.ndarray, k: int, way: int, known: dict) -> tuple:
        """What the chunk leaves after a turn at row k into `way`: (way, start or None: as at that turn, extreme)."""
        path = []
        while (k, way) not in known:
            nxt = self._turn(v, k, way)
            e = self._extreme(v, k, min(nxt + 1, len(v)), way)
            if nxt == len(v):
                known[k, way] = (way, None, (float(t[e]), float(v[e])))
                break
            path.append(((k, way), (float(t[e]), float(v[e]))))
            k, way = nxt, -way
        out = known[k, way]
        for node, start in reversed(path):
            out = known[node] = (out[0], out[1] or start, out[2])
        return out

    def summary(self, rows: dict) -> dict:
        t, v = np.asarray(rows[self.t], float), np.asarray(rows[self.level], float)
        known: dict = {}
        made = {}
        for way in (1, -1):
            own = self._turn(v, 0, way)
            w = way * v[:own]
            records = np.flatnonzero(np.diff(np.minimum.accumulate(w), prepend=np.inf) < 0) if own else np.zeros(0, int)
            turns = [*records.tolist(), own] if own < len(v) else records.tolist()
            high = [self._extreme(v, 0, k + 1, way) for k in turns]
            e = self._extreme(v, 0, len(v), way)
            made[way] = {
                "row": turns, "v": [float(v[k]) for k in turns], "own": own < len(v), "high": [(float(t[k]), float(v[k])) for k in high],
                "leaves": [self._from(t, v, k, -way, known) for k in turns], "all": (float(t[e]), float(v[e])),
            }
        return made | {"first": (float(t[0]), float(v[0]))}

    def _turned(self, made: dict, way: int, extreme: tuple) -> tuple | None:
        """(row of the turn, extreme there, what the chunk leaves) for an extreme brought along."""
        m = made[way]
        for k in range(len(m["row"])):
            if way * (extreme[1] - m["v"][k]) >= self.step or m["own"] and k + 1 == len(m["row"]):
                top = extreme if way * extreme[1] >= way * m["high"][k][1] else m["high"][k]
                return m["row"][k], top, m["leaves"][k]
        return None

    def follow(self, made: dict, state: tuple | None) -> tuple:
        way, start, top, low = state or (0, made["first"], made["first"], made["first"])
        down = self._turned(made, 1, top) if way >= 0 else None
        up = self._turned(made, -1, low) if way <= 0 else None
        if down is None and up is None:
            far = lambda w, x: x if w * x[1] >= w * made[w]["all"][1] else made[w]["all"]
            return way, start, far(1, top), far(-1, low)
        _, extreme, (way, since, new) = down if up is None or down is not None and down[0] <= up[0] else up
        return way, since or extreme, new, new

    def run(self, rows: dict, state: tuple | None, last: bool) -> Iterator[tuple]:
        t, v = np.asarray(rows[self.t], float).tolist(), np.asarray(rows[self.level], float).tolist()
        way, start, top, low = state or (0, (t[0], v[0]), (t[0], v[0]), (t[0], v[0]))
        for here in zip(t, v, strict=True):
            top, low = here if here[1] > top[1] else top, here if here[1] < low[1] else low
            if way >= 0 and top[1] - here[1] >= self.step:
                turn, to = top, -1
            elif way <= 0 and here[1] - low[1] >= self.step:
                turn, to = low, 1
            else:
                continue
            if turn[0] > start[0]:
                yield (*start, *turn)
            start, way, top, low = turn, to, here, here
        if last and t[-1] > start[0]:
            yield (*start, t[-1], v[-1])
