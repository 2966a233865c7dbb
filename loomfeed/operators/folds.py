"""Latest, first and merged rows per key; prefixes within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order, by a window; its rank filter is applied below the shuffle too. latest_by() has no sort."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_by(df: DataFrame, keys: list[str], *stamp: str) -> DataFrame:
    """The row with the largest stamp of each key, by a partially aggregated maximum instead of a sort of all rows."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in stamp], *[F.col(c) for c in rest if c not in stamp])
    return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def top_n_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; the rank filter is pushed below the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def priority_dedup(frames: list[DataFrame], key: str, pos: str) -> DataFrame:
    """Rows of several frames, one per key: an earlier frame wins, then the smaller position."""
    union = None
    for i, f in enumerate(frames):
        f = f.withColumn("priority", F.lit(i))
        union = f if union is None else union.unionByName(f)
    return latest_per_key(union, [key], F.col("priority"), F.col(pos))


def fold_merge(df: DataFrame, key: str, pos: str, longest: list[str], first: list[str]) -> DataFrame:
    """One row per key: its first position, the longest value (ties: earlier) and the first non-empty value of columns."""
    aggs = [F.min(pos).alias(pos)]
    aggs += [F.max_by(c, F.struct(F.length(c), -F.col(pos))).alias(c) for c in longest]
    aggs += [F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(pos))), F.lit("")).alias(c) for c in first]
    return df.groupBy(key).agg(*aggs)


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each key in order as long as their running size stays within the budget; a large key is summed in many ranges."""
    return running(df, keys, order, {"used": ("sum", size)}).where(F.col("used") <= budget)


def newest(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """Top k; the limit is held to 1..1000."""
    return df.orderBy(*order).limit(max(1, min(limit, 1000)))
