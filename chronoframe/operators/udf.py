"""User functions over tables: detectors on row batches, folds per recording, aggregates, and rows from rows."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .folds import in_groups

#: Rows of a key from which on they are dealt to more than one task; the list of such keys is broadcast, one for so many rows.
MANY = 4096


def apply_detector(df: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """detect() sees batches of rows and returns rows of the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield detect(batch)

    return df.mapInPandas(run, schema)


def apply_per_key(df: DataFrame, by: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str = "t") -> DataFrame:
    """fold() sees one recording at a time, in order."""
    return df.groupBy(*by).applyInPandas(lambda g: fold(g.sort_values(order)), schema)


def register_aggregate(reduce: Callable[[pd.Series], float], kind: str = "double") -> Callable[..., Column]:
    """A column aggregate from a function of all values of a group."""

    def aggregate(v: pd.Series) -> float:
        return reduce(v)

    return F.pandas_udf(aggregate, kind)


def explode_rows(df: DataFrame, make: Callable[..., Iterator[tuple]], args: list[str], schema: str) -> DataFrame:
    """Each row once for every row that make() returns for its arguments, with their columns."""

    class Rows:
        def eval(self, *values):
            yield from make(*values)

    rows = F.udtf(Rows, returnType=schema)
    return df.alias("x").lateralJoin(rows(*(F.col(f"x.{a}").outer() for a in args)))


def mergeable_aggregate(df: DataFrame, by: list[str], columns: list[str], init: Callable[[], object], update: Callable[[object, pd.DataFrame], object], merge: Callable[[object, object], object], finish: Callable[[object], tuple], out: str, salts: int = 32, keys: int = 100_000) -> DataFrame:
    """A user aggregate in pieces: rows are dealt by key, those of a key with many by a salt besides, so that a hot key spreads;
    each task folds its rows, batch by batch, into one state a key (update), states are merged by key, and finish() gives the
    columns `out`. Rows of a key come together, so update() runs about once a key. Keys may be null; at most `keys` states are
    held in a task before they are passed on."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def passed_on(states: dict) -> pd.DataFrame:
        rows = [(*key[:-1], pickle.dumps(state)) for key, state in states.items()]
        states.clear()
        return pd.DataFrame(rows, columns=[*by, "_state"]).astype({c: object for c in by})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for batch in batches:
            for key, rows in batch.groupby([*by, "_salt"], dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                states[key] = update(states[key] if key in states else init(), rows[columns])
            if len(states) >= keys:
                yield passed_on(states)
        yield passed_on(states)

    def merged(group: dict) -> object:
        return functools.reduce(merge, map(pickle.loads, group["_state"]))

    same = lambda c: F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    many = df.groupBy(*(F.col(c).alias(f"_same_{c}") for c in by)).agg(F.count("*").alias("_n")).where(F.col("_n") > MANY)
    rows = df.select(*by, *(c for c in columns if c not in by)).join(F.broadcast(many), functools.reduce(Column.__and__, map(same, by)), "left")
    salt = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.least(F.ceil(F.col("_n") / MANY), F.lit(salts))))
    rows = rows.withColumn("_salt", salt.cast("long")).drop("_n", *many.columns)
    parts = rows.repartition(*by, "_salt").sortWithinPartitions(*by, "_salt").mapInPandas(fold, f"{kinds}, _state binary")
    return in_groups(parts, by, [], lambda g: [finish(merged(g))], out)


def rows_in_order(df: DataFrame, by: list[str], order: list[str], folder: Callable[[], object], schema: Callable[[StructType], StructType]) -> DataFrame:
    """Rows from the rows of each key, in order, as they pass: folder() makes an object whose feed(row) and end() yield tuples,
    so a key is never held whole. A table function over a partitioned and ordered table; its schema is worked out by schema()
    from that of the input."""

    class InOrder:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(schema=schema(rows.dataType), partitionBy=[PartitioningColumn(c) for c in by], orderBy=[OrderingColumn(c) for c in order])

        def __init__(self):
            self.folder = folder()

        def eval(self, row: Row):
            yield from self.folder.feed(row)

        def terminate(self):
            yield from self.folder.end()

    return F.udtf(InOrder)(df.asTable())
