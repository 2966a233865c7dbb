"""Reservations admitted in order: an admitted one uses up the budget of those that follow, a refused one does not."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import ZONE, civil_day, day_bounds
from ..session import discard, materialise


@dataclass(frozen=True)
class Limits:
    """Of a civil day and a civil month of one scope; requests and tokens of 0 allow nothing, a cost of 0 is no limit."""

    daily_requests: int
    daily_tokens: int
    monthly_requests: int
    monthly_tokens: int
    daily_cost: int = 0
    monthly_cost: int = 0


#: Rules in the order in which they name the reason: field of Limits, window, quantity.
_RULES = (("daily_requests", "day", 0), ("daily_tokens", "day", 1), ("monthly_requests", "month", 0), ("monthly_tokens", "month", 1), ("daily_cost", "day", 2), ("monthly_cost", "month", 2))

_DECISION = "scope string, id long, job string, month date, day date, decision string, reason string, blocked_by_day boolean, blocked_by_month boolean, attempt long"


class _Budget:
    """Totals of one scope and month, by day and for the month: requests, tokens, cost."""

    def __init__(self, limits: Limits):
        self.rules = [(name, window, q, getattr(limits, name)) for name, window, q in _RULES]
        self.month, self.days = [0, 0, 0], {}

    def add(self, day, amounts: tuple[int, int, int]) -> None:
        of_day = self.days.setdefault(day, [0, 0, 0])
        for q, x in enumerate(amounts):
            of_day[q] += x
            self.month[q] += x

    def judge(self, day, tokens: int, cost: int) -> tuple[str, str | None, bool, bool]:
        """(decision, reason, whether the day's and the month's reset must be waited for)."""
        asked, of_day = (1, tokens, cost), self.days.get(day, (0, 0, 0))
        never, later = [], []
        for name, window, q, limit in self.rules:
            if limit <= 0 and q == 2:
                continue
            if limit <= 0 or q and asked[q] > limit:
                never.append(name)
            elif (of_day if window == "day" else self.month)[q] + asked[q] > limit:
                later.append((name, window))
        if never:
            return "impossible", never[0], False, False
        if later:
            windows = {w for _, w in later}
            return "blocked", later[0][0], "day" in windows, "month" in windows
        return "admitted", None, False, False


def _fold(events: DataFrame, limits: Limits, max_attempts: int) -> DataFrame:
    """Decisions of all requests, a scope and month at a time and in order; what is carried from row to row is bounded by what is still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, budget, jobs, opened = None, None, {}, {}
        for b in batches:
            out = []
            for kind, scope, month, day, i, job, tokens, cost, requests, cached, more, settles in zip(*(c.to_pylist() for c in b.columns[:12]), strict=True):
                if (scope, month) != at:
                    at, budget, jobs, opened = (scope, month), _Budget(limits), {}, {}
                if kind == 0:  # carried usage, or a job's history (attempts in requests, -1: ended)
                    if job is None:
                        budget.add(day, (requests, tokens, cost))
                    else:
                        jobs[job] = requests
                    continue
                if kind == 2:  # the actual usage replaces the reserved one
                    if held := opened.pop(i, None):
                        budget.add(held[0], (0, tokens - held[1], cost - held[2]))
                    continue
                done = jobs.get(job, 0)
                decision, reason, wait_day, wait_month, attempt = "conflict", "ended", False, False, None
                if cached:
                    decision, reason = "cached", None
                elif done >= max_attempts:
                    decision, reason, done = "attempt_limit", "attempts", -1
                elif done >= 0:
                    decision, reason, wait_day, wait_month = budget.judge(day, tokens, cost)
                    if decision == "admitted":
                        budget.add(day, (1, tokens, cost))
                        done += 1
                        attempt = done
                        if settles:
                            opened[i] = (day, tokens, cost)
                    elif decision == "impossible":
                        done = -1
                if more and done:
                    jobs[job] = done
                elif not more:
                    jobs.pop(job, None)
                out.append((scope, i, job, month, day, decision, reason, wait_day, wait_month, attempt))
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds = (pa.string(), pa.int64(), pa.string(), pa.date32(), pa.date32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.strip().split(" ")[0] for c in _DECISION.split(",")])

    cols = ["kind", "scope", "month", "day", "id", "job", "tokens", "cost", "requests", "cached", "more", "settles", "ts"]
    return events.select(*cols).repartition("scope", "month").sortWithinPartitions("scope", "month", F.col("kind") > 0, "ts", "kind", "id").mapInArrow(run, _DECISION)


def admit(requests: DataFrame, limits: Limits, settlements: DataFrame | None = None, carried: DataFrame | None = None, max_attempts: int = 3, zone: str = ZONE) -> DataFrame:
    """requests (scope, id, job, ts, tokens, cost, cached) with decision, reason, next_attempt and attempt.

    Requests of a scope are decided in the order of (ts, id), each by what the admitted ones
    before it have reserved on its civil day and in its civil month. cached: the result is
    there already. attempt_limit: the job was admitted max_attempts times. impossible: over a
    limit by itself; it ends its job, as the attempt limit does, and later requests of the
    job are a conflict. blocked: with next_attempt, the last reset of the limits that it would
    break. admitted: attempt counts the job's admissions.

    settlements (id, at, tokens, cost) replace a reservation by its actual usage from `at` on;
    at one time requests come first. carried (scope, day, requests, tokens, cost) are used up
    before any request. Nulls count as 0 or false; ids are unique; requests of null scope
    or job count as scope or job ''.

    Scopes and months are decided side by side, each in one ordered pass that keeps 31 days'
    sums, the jobs that ask again and the reservations that are yet to be settled. A job that
    asks in several months is decided from its history in the months before, which is first
    taken as empty and then corrected until it stays: the first months are right at once,
    each round settles at least one more.
    """
    empty = F.lit("")
    r = requests.select(F.coalesce(F.col("scope").cast("string"), empty).alias("scope"), "id", F.coalesce(F.col("job").cast("string"), empty).alias("job"), "ts", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("tokens", "cost")], F.coalesce("cached", F.lit(False)).alias("cached"))
    r = r.withColumn("day", civil_day(F.col("ts"), zone)).withColumn("month", F.trunc("day", "month"))
    last = Window.partitionBy("scope", "month", "job").orderBy("ts", "id")
    r = r.withColumns({"more": F.lead("id").over(last).isNotNull(), "kind": F.lit(1), "requests": F.lit(0).cast("long")})
    if settlements is not None:
        s = settlements.select("id", F.col("at").alias("_at"), F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("_tokens"), F.coalesce(F.col("cost").cast("long"), F.lit(0).cast("long")).alias("_cost"))
        r = materialise(r.join(s, "id", "left"), "requests")
        inside = (F.col("_at") >= F.col("ts")) & (F.trunc(civil_day(F.col("_at"), zone), "month") == F.col("month"))
        r = r.withColumn("settles", F.coalesce(inside, F.lit(False)))
        done = r.where("settles").withColumns({"kind": F.lit(2), "ts": F.col("_at"), "tokens": F.col("_tokens"), "cost": F.col("_cost")})
        asked = r.drop("_at", "_tokens", "_cost")
        events = asked.unionByName(done.drop("_at", "_tokens", "_cost"))
    else:
        asked = events = r = materialise(r.withColumn("settles", F.lit(False)), "requests")
    if carried is not None:
        c = carried.select(F.coalesce(F.col("scope").cast("string"), empty).alias("scope"), "day", F.trunc("day", "month").alias("month"), F.lit(0).alias("kind"), *[F.coalesce(F.col(x).cast("long"), F.lit(0).cast("long")).alias(x) for x in ("requests", "tokens", "cost")])
        events = events.unionByName(c.join(asked.select("scope", "month").distinct(), ["scope", "month"], "left_semi"), allowMissingColumns=True)
    wide = asked.groupBy("scope", "job").agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a < b").select("scope", "job")
    wide = materialise(asked.join(wide, ["scope", "job"], "left_semi").select("scope", "job", "month").distinct(), "wide")
    history, rounds = None, not wide.isEmpty()
    while True:
        given = events
        if history is not None:
            given = events.unionByName(history.select("scope", "job", "month", F.lit(0).alias("kind"), F.col("done").alias("requests")), allowMissingColumns=True)
        found = materialise(_fold(given, limits, max_attempts), "decisions")
        if not rounds:
            break
        own = found.groupBy("scope", "job", "month").agg(F.count_if(F.col("decision") == "admitted").alias("n"), F.bool_or(F.col("decision").isin("impossible", "attempt_limit")).alias("over"))
        before = Window.partitionBy("scope", "job").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
        now = wide.join(own, ["scope", "job", "month"], "left")
        now = now.select("scope", "job", "month", F.when(F.max("over").over(before), -1).otherwise(F.sum("n").over(before)).cast("long").alias("done"))
        now = materialise(now.where("done <> 0"), "history")
        same = history is not None and now.exceptAll(history).isEmpty() and history.exceptAll(now).isEmpty() or history is None and now.isEmpty()
        for old in [x for x in (history, None if same else found) if x is not None]:
            discard(old)
        history = now
        if same:
            break
    reset = F.greatest(F.when(F.col("blocked_by_day"), day_bounds(F.col("day"), zone)[1]), F.when(F.col("blocked_by_month"), F.to_utc_timestamp(F.add_months("month", 1).cast("timestamp"), zone)))
    return found.select("scope", "id", "job", "decision", "reason", reset.alias("next_attempt"), "attempt")
