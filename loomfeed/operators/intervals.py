"""Joins of intervals of any length: pairs that overlap, rows that no interval holds, intervals put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scan import running


def _level(start: Column, end: Column) -> Column:
    """The smallest power of two, as exponent, that is not below the length: an interval touches at most two bins of its level."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")


def _bins(start: Column, end: Column, level: Column) -> Column:
    return F.sequence(F.floor(start / F.pow(F.lit(2.0), level)).cast("long"), F.floor((end - 1) / F.pow(F.lit(2.0), level)).cast("long"))


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows of equal keys whose intervals [start, end) of whole numbers share a number; right's columns get a trailing `_r`, the keys stay.

    Every interval has a level, the power of two at its length, and stands in the at most two
    bins of that level it touches. An interval meets the shorter ones of the other side in its
    own bins and the longer ones in the bins of their levels, of which there are at most
    64. A pair is put out where the later of both starts lies, so once. Empty and reversed
    intervals, null bounds and null keys meet nothing.
    """
    keys = keys or []

    def prepared(df: DataFrame, suffix: str) -> DataFrame:
        rest = [F.col(c).alias(c if c in keys else c + suffix) for c in df.columns]
        lo, hi = F.col(start + suffix).cast("long"), F.col(end + suffix).cast("long")
        return df.select(*rest).where(hi > lo).withColumns({"_level" + suffix: _level(lo, hi)})

    a, b = materialise(prepared(left, ""), "intervals"), materialise(prepared(right, "_r"), "intervals")
    levels_a, levels_b = (sorted(r[0] for r in x.select(c).distinct().collect()) for x, c in ((a, "_level"), (b, "_level_r")))  # at most 64 each

    def placed(df: DataFrame, suffix: str, at: Column, bin_name: str) -> DataFrame:
        lo, hi = F.col(start + suffix).cast("long"), F.col(end + suffix).cast("long")
        out = df.withColumn("_at", at)
        return out.withColumn(bin_name, F.explode(_bins(lo, hi, F.col("_at"))))

    def at_levels(levels: list[int], own: str, least: int) -> Column:
        """Those of the other side's levels that are above the row's own one, or as high with least 0."""
        return F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col(own) + least))

    def met(home: DataFrame, home_suffix: str, visitor: DataFrame, visitor_suffix: str, levels: list[int], least: int) -> DataFrame:
        h = placed(home, home_suffix, F.col("_level" + home_suffix), "_bin")
        v = placed(visitor, visitor_suffix, at_levels(levels, "_level" + visitor_suffix, least), "_bin")
        j = h.join(v, [*keys, "_at", "_bin"])
        later = F.greatest(F.col(start).cast("long"), F.col(start + "_r").cast("long"))
        sooner = F.least(F.col(end).cast("long"), F.col(end + "_r").cast("long"))
        one = F.floor(later / F.pow(F.lit(2.0), F.col("_at"))) == F.col("_bin")
        return j.where((later < sooner) & one).select(*keys, *[c for c in a.columns if c not in keys and not c.startswith("_level")], *[c for c in b.columns if c not in keys and not c.startswith("_level")])

    return met(a, "", b, "_r", levels_a, 0).unionByName(met(b, "_r", a, "", levels_b, 1))


def merged(intervals: DataFrame, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """keys, start, end of the runs of intervals that overlap or touch, by a running maximum of ends; empty intervals are left out."""
    keys = keys or []
    rows = intervals.where(F.col(end) > F.col(start)).select(*keys, start, end)
    far = running(rows, keys, [F.col(start), F.col(end)], {"_far": ("max", F.col(end))}, before=True)
    opens = F.when(F.col("_far").isNull() | (F.col("_far") < F.col(start)), 1).otherwise(0)
    runs = running(far, keys, [F.col(start), F.col(end), F.col("_far")], {"_run": ("sum", opens)})
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def not_inside(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, through: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Points that no interval [start, end) of equal keys holds, of those with a null time all; with `through`, an interval holds points up to and with it only.

    One pass in the order of time over both: a point is held if some interval that has begun
    ends after it, so the running maximum of ends decides. Intervals may overlap and be
    of any length; null keys match each other; nothing is paired.
    """
    keys = keys or []
    stop = F.col(end)
    if through is not None:  # up to and with it: a point at `through` is still held
        stop = F.least(F.col(end), F.col(through))
    held = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    if through is not None:
        held = held.where(F.col(through).isNotNull())
    inclusive = (F.col(through) < F.col(end)) if through is not None else F.lit(False)
    held = held.select(*keys, F.col(start).alias("_at"), F.struct(stop.alias("stop"), inclusive.alias("inclusive")).alias("_stop"), F.lit(0).alias("_kind"))
    p = points.withColumns({"_at": F.col(at), "_kind": F.lit(1)})
    both = p.unionByName(held, allowMissingColumns=True)
    far = running(both, keys, [F.col("_at").asc_nulls_first(), F.col("_kind")], {"_far": ("max", F.col("_stop"))})
    inside = (F.col("_far.stop") > F.col("_at")) | ((F.col("_far.stop") == F.col("_at")) & F.col("_far.inclusive"))
    return far.where((F.col("_kind") == 1) & ~F.coalesce(inside, F.lit(False))).select(*points.columns)
