"""Joins that need a plan of their own: either-key matches, day-range anti-joins, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import civil_day
from .scan import running


def either_key_match(probe: DataFrame, stored: DataFrame, probe_id: str, within: str, key_a: str, key_b: str, stored_id: str) -> DataFrame:
    """probe_id, match_id: the smallest stored id with the same `within` and either key equal.

    Two equality joins and a minimum; one join with OR would be a nested loop.
    """
    p, s = probe.select(probe_id, within, key_a, key_b), stored.select(F.col(stored_id).alias("match_id"), within, key_a, key_b)
    a = p.join(s.drop(key_b), [within, key_a]).select(probe_id, "match_id")
    b = p.join(s.drop(key_a), [within, key_b]).select(probe_id, "match_id")
    return a.unionByName(b).groupBy(probe_id).agg(F.min("match_id").alias("match_id"))


def not_carried(attempts: DataFrame, ledger: DataFrame, ts: str) -> DataFrame:
    """Attempts that no carried day has counted: its civil day is not in the ledger, or it came after covered_through.

    The day makes it an equality join; days of a ledger do not overlap.
    """
    days = ledger.select(F.col("day").alias("_day"), "covered_through")
    a = attempts.withColumn("_day", civil_day(F.col(ts)))
    return a.join(days, (a["_day"] == days["_day"]) & (a[ts] <= days["covered_through"]), "left_anti").drop("_day")


def seen_diff(entries: DataFrame, seen: DataFrame, keys: list[str], modified: str) -> DataFrame:
    """entries with change: baseline if nothing of the source was seen, else new, modified or same.

    modified needs both dates to be non-empty and to differ.
    """
    source = keys[0]
    known = seen.select(*keys, F.col(modified).alias("_old"), F.lit(True).alias("_hit"))
    sources = seen.select(source).distinct().withColumn("_any", F.lit(True))
    e = entries.join(known, keys, "left").join(sources, source, "left")
    old, now = F.coalesce("_old", F.lit("")), F.coalesce(modified, F.lit(""))
    change = F.when(F.col("_any").isNull(), "baseline").when(F.col("_hit").isNull(), "new").when((old != "") & (now != "") & (old != now), "modified").otherwise("same")
    return e.withColumn("change", change).drop("_old", "_hit", "_any")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def with_children(parent: DataFrame, child: DataFrame, key: str, fields: list[str], order: list[str], name: str) -> DataFrame:
    """parent with an ordered array of its children's fields; empty if it has none."""
    rows = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    return parent.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def overlaps(df: DataFrame, start: str, end: str, within: list[str] | None = None) -> DataFrame:
    """Rows that start before the row before them has ended; a large group, or no grouping at all, is checked in many ranges."""
    return running(df, within or [], [F.col(start), F.col(end)], {"previous_end": ("last", F.col(end))}).where(F.col(start) < F.col("previous_end"))
