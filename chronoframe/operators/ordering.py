"""Orders, top-k, set operations and updates of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_order(df: DataFrame, by: list[str], time: str, *ties: Column | str) -> DataFrame:
    """pos of each row in its key's order of time, then ties, from 1; a row without a time has no place and goes."""
    return df.where(F.col(time).isNotNull()).withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(time, *ties)))


def worst_n(df: DataFrame, severity: str, key: str, n: int = 8) -> DataFrame:
    """The n worst rows, worst first: the limit is the feature."""
    return df.orderBy(F.desc(severity), key).limit(n)


def order_findings(df: DataFrame) -> DataFrame:
    """rank of each finding: errors before warnings, then rule number, then found order."""
    error = ~F.col("rule").startswith("W")
    w = Window.partitionBy("doc").orderBy(F.desc(error), F.regexp_extract("rule", r"(\d+)$", 1).cast("int"), "pos", "rule")
    return df.withColumn("rank", F.row_number().over(w))


def round_robin_cap(df: DataFrame, by: list[str], group: str, order: str, n: int) -> DataFrame:
    """n rows per key shared over groups a round at a time, groups in order."""
    d = df.withColumn("_round", F.row_number().over(Window.partitionBy(*by, group).orderBy(order)))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_round", group)))
    return d.where(F.col("_k") <= n).drop("_round", "_k")


def rank_candidates(df: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """rank by score, then ties, and the margin to the runner-up."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 6)), *ties)
    return df.withColumns({"rank": F.row_number().over(w), "margin": F.round(F.col(score) - F.lead(score).over(w), 6)})


def pick_extremes(df: DataFrame, by: list[str], key: str, length: str, density: str) -> DataFrame:
    """Longest, shortest and densest row; a null density counts as the densest."""
    k = -F.col(key)
    return df.groupBy(*by).agg(F.max_by(key, F.struct(F.col(length), k)).alias("longest"), F.min_by(key, F.struct(F.col(length), F.col(key))).alias("shortest"), F.max_by(key, F.struct(F.coalesce(F.col(density), F.lit(float("inf"))), k)).alias("densest"))


def union_events(**catalogs: DataFrame) -> DataFrame:
    """Catalogs as one event table with their kind."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("kind", F.lit(k)) for k, df in catalogs.items()))


def merge_signals(primary: DataFrame, secondary: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """All primary rows, and the secondary ones that no primary row is near."""
    from .joins import exists_near

    apart = exists_near(secondary, primary.select(*by, "t"), by, tolerance).where(~F.col("near")).drop("near")
    return primary.withColumn("signal", F.lit("primary")).unionByName(apart.withColumn("signal", F.lit("secondary")))


def dedupe_adjacent(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Without the first row and repeats of the row before."""
    w = Window.partitionBy(*by).orderBy("t")
    return df.withColumns({"_p": F.lag(col).over(w), "_n": F.row_number().over(w)}).where("_n > 1").where(~F.col(col).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def roster(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*columns)).alias("name")).where("name is not null").distinct()


def duplicate_ids(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """One row per repeat of an id across tables that share a namespace."""
    everything = reduce(DataFrame.unionByName, (df.select(*by, "id", F.lit(n).alias("table")) for n, df in tables.items()))
    k = F.row_number().over(Window.partitionBy(*by, "id").orderBy("table"))
    return everything.withColumn("k", k).where("k > 1")


def promote(main: Column, alternates: Column, k: int) -> tuple[Column, Column]:
    """Main swapped with its k-th alternate (from 1), the order kept."""
    return F.coalesce(F.get(alternates, F.lit(k - 1)), main), F.transform(alternates, lambda x, i: F.when(i == k - 1, main).otherwise(x))


def split_kept(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """reason: the first rule a row breaks; null for rows kept."""
    return df.withColumn("reason", F.coalesce(*(F.when(c, n) for n, c in rules.items())))


def upsert_status(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str], order: str, replace: bool = False) -> DataFrame:
    """Per incoming row: unchanged, refused (occupied), replaced or added; later rows see earlier ones of the batch."""
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))
    e = existing.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old"))
    w = Window.partitionBy(key).orderBy(order)
    rows = incoming.withColumn("_new", F.struct(*columns)).join(e, F.col(key) == F.col("_key"), "left")
    seen = F.lag("_new").over(w) if replace else F.first("_new").over(w)
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("_seen", F.when(first, F.col("_old")).otherwise(seen if replace else F.coalesce("_old", seen)))
    status = F.when(F.col("_seen").isNull(), "added").when(same(F.col("_seen"), F.col("_new")), "unchanged").otherwise("replaced" if replace else "refused")
    return rows.withColumn("status", status).drop("_new", "_old", "_key", "_seen")


def requested_points(asks: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Asked times as whole positions, each once, with ok for those inside the bounds."""
    p = asks.select(*by, F.floor("t").alias("at")).distinct().join(bounds, by, "left")
    return p.select(*by, "at", F.coalesce((F.col("at") >= F.col("first")) & (F.col("at") < F.col("last")), F.lit(False)).alias("ok"))
