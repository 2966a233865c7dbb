"""Usage accounting: totals with a carried ledger, daily roll-ups, budgets and ledger checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ZONE, civil_day, day_bounds, month_bounds
from .joins import not_carried

COUNTERS = ("input", "cached", "cache_write", "output", "reasoning", "total", "cost_micros")


def _reserved_or_actual(reserved: str, actual: str) -> Column:
    return F.when(F.col("reservation_active") == 1, F.col(reserved)).otherwise(F.coalesce(actual, F.lit(0)))


def totals_since(attempts: DataFrame, ledger: DataFrame, since: Column) -> DataFrame:
    """One row: requests, tokens and cost of attempts since `since` that no carried day holds, plus the carried days that end after it."""
    own = not_carried(attempts.where(F.col("started") >= since), ledger, "started")
    own = own.agg(F.count("*").alias("requests"), F.sum(_reserved_or_actual("reserved_total", "actual_total")).alias("tokens"), F.sum(_reserved_or_actual("reserved_cost", "actual_cost")).alias("cost_micros"))
    carried = ledger.where(day_bounds(F.col("day"))[1] > since).agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost_micros").alias("cost_micros"))
    return own.unionByName(carried).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("requests", "tokens", "cost_micros")))


def counters() -> list[Column]:
    """Aggregates of attempts: requests by kind, reserved amounts, used amounts.

    A reservation that is still active counts as unconfirmed with its reserved amounts; an
    attempt without actual usage as unconfirmed only; others are confirmed with what they
    used; uncached input is what is neither read from nor written to the cache.
    """
    active, missing = F.col("reservation_active") == 1, F.col("actual_total").isNull()
    confirmed = ~active & ~missing

    def used(c: str | Column) -> Column:
        return F.coalesce(F.sum(F.when(confirmed, c if isinstance(c, Column) else F.coalesce(c, F.lit(0)))), F.lit(0)).cast("long")

    n = lambda c: F.count_if(c).cast("long")
    return [
        F.count("*").cast("long").alias("requests"),
        n(confirmed).alias("confirmed"),
        n(active | missing).alias("unconfirmed"),
        F.coalesce(F.sum(F.when(active, F.col("reserved_total"))), F.lit(0)).cast("long").alias("reserved_tokens"),
        F.coalesce(F.sum(F.when(active, F.col("reserved_cost"))), F.lit(0)).cast("long").alias("reserved_cost"),
        *(used(f"actual_{c}").alias(c) for c in ("input", "cached", "cache_write", "output", "reasoning", "total", "cost")),
        used(F.greatest(F.lit(0), F.coalesce("actual_input", F.lit(0)) - F.coalesce("actual_cached", F.lit(0)) - F.coalesce("actual_cache_write", F.lit(0)))).alias("cache_miss"),
    ]


def daily_rollup(attempts: DataFrame, ledger: DataFrame | None = None, zone: str = ZONE, keep_days: int | None = None) -> DataFrame:
    """One row per civil day of the zone with its counters(), merged with carried days."""
    a = attempts if ledger is None else not_carried(attempts, ledger, "started")
    out = a.groupBy(civil_day(F.col("started"), zone).alias("day")).agg(*counters())
    if ledger is not None:
        both = out.unionByName(ledger.select([c for c in ledger.columns if c in out.columns]), allowMissingColumns=True)
        out = both.groupBy("day").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in out.columns if c != "day"))
    if keep_days is not None:
        last = out.agg(F.max("day").alias("_last"))
        out = out.join(F.broadcast(last), F.col("day") > F.date_sub("_last", keep_days)).drop("_last")  # one row
    return out


def budget_decisions(requests: DataFrame, usage: DataFrame, daily: int, monthly: int) -> DataFrame:
    """requests (id, ts, tokens) with decision and next_reset.

    usage: day, tokens already used. impossible if a request is over a limit by itself,
    blocked until the later reset of the limits that it would break, else allowed.
    """
    day = civil_day(F.col("ts"))
    months = usage.groupBy(F.trunc("day", "month").alias("_month")).agg(F.sum("tokens").alias("month_used"))
    r = requests.withColumn("_day", day).withColumn("_month", F.trunc("_day", "month"))
    r = r.join(usage.select(F.col("day").alias("_day"), F.col("tokens").alias("day_used")), "_day", "left").join(months, "_month", "left").fillna(0, ["day_used", "month_used"])
    over_day, over_month = F.col("day_used") + F.col("tokens") > daily, F.col("month_used") + F.col("tokens") > monthly
    decision = F.when(F.col("tokens") > min(daily, monthly), "impossible").when(over_day | over_month, "blocked").otherwise("allowed")
    reset = F.greatest(F.when(over_day, day_bounds(F.col("_day"))[1]), F.when(over_month, month_bounds(F.col("ts"))[1]))
    return r.withColumns({"decision": decision, "next_reset": F.when(decision == "blocked", reset)}).drop("_day", "_month")


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """Rows that break an identity of the ledger, with the first broken rule."""
    rules = F.when(F.col("confirmed") + F.col("unconfirmed") != F.col("requests"), "requests").when(F.col("cached") + F.col("cache_miss") + F.col("cache_write") != F.col("input"), "input").when(F.col("reasoning") > F.col("output"), "reasoning").when(F.col("total") < F.col("input") + F.col("output"), "total").when((F.col("reserved_tokens") > 0) & (F.col("unconfirmed") == 0), "reserved")
    return ledger.withColumn("rule", rules).where("rule IS NOT NULL")
