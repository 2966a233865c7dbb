"""The daily usage roll-up as a stream: late and repeated rows, and state that goes after the retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import ZONE, civil_day, day_bounds
from ..operators.joins import not_carried
from ..operators.usage import counters


def daily_usage(attempts: DataFrame, ledger: DataFrame | None = None, zone: str = ZONE, keep_days: int = 62) -> DataFrame:
    """Per batch the changed civil days with their counters so far; run it in update mode.

    attempts: a stream with id, started and the usage columns. Rows that a carried day has
    counted already (by its covered_through) are passed over, as are repeated ids. The
    watermark follows the ends of civil days, so days of 23 and 25 hours go as whole days:
    state of a day is dropped once a day is seen that ends more than keep_days later, and rows
    of such days are late and ignored; ids are remembered for twice as long.
    """
    a = attempts if ledger is None else not_carried(attempts, ledger, "started")
    day = civil_day(F.col("started"), zone)
    a = a.withColumn("day_end", day_bounds(day, zone)[1]).withWatermark("day_end", f"{keep_days * 24} hours").dropDuplicatesWithinWatermark(["id"])
    return a.groupBy("day_end").agg(*counters()).withColumn("day", F.date_sub(F.to_date(F.from_utc_timestamp("day_end", zone)), 1)).drop("day_end")


def settled_days(changes: DataFrame, ledger: DataFrame | None = None, keep_days: int = 62) -> DataFrame:
    """The roll-up after the last batch: the last row of each day in changes (day, counters, batch), with carried days added, of the last keep_days."""
    names = [c for c in changes.columns if c not in ("day", "batch")]
    last = changes.groupBy("day").agg(F.max_by(F.struct(*names), "batch").alias("l")).select("day", "l.*")
    if ledger is not None:
        last = last.unionByName(ledger.select([c for c in ledger.columns if c in last.columns]), allowMissingColumns=True).groupBy("day").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names))
    top = last.agg(F.max("day").alias("_last"))
    return last.join(F.broadcast(top), F.col("day") > F.date_sub("_last", keep_days)).drop("_last")  # one row
