"""Leased jobs as a stream of recorded events: a lease that runs out returns its job to the queue by a timer of that job alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import running

#: Events of a job; anything else is ignored.
KINDS = ("enqueue", "lease", "renew", "complete", "fail")
_CHANGE = "at long, state string, attempts long, reason string"


class _Job:
    """State of one job: where it is, how often it was leased, until when."""

    def __init__(self, state: str = "", attempts: int = 0, until: int = 0):
        self.state, self.attempts, self.until = state, attempts, until

    def expire(self, now: int) -> list[tuple]:
        """The end of a lease that ran out before `now`."""
        if self.state != "leased" or self.until >= now:
            return []
        self.state = "retryable"
        return [(self.until, "retryable", self.attempts, "lease_expired")]

    def step(self, at: int, kind: str, seconds: int, most: int) -> list[tuple]:
        """What an event changes, an expired lease first."""
        out = self.expire(at)
        if kind == "enqueue" and self.state in ("", "succeeded", "failed"):
            self.state, self.attempts = "queued", 0
        elif kind == "lease" and self.state in ("queued", "retryable") and self.attempts < most:
            self.state, self.attempts, self.until = "leased", self.attempts + 1, at + seconds
        elif kind == "renew" and self.state == "leased":
            self.until = at + seconds
            return out
        elif kind == "complete" and self.state == "leased":
            self.state = "succeeded"
        elif kind == "fail" and self.state == "leased":
            self.state = "retryable" if self.attempts < most else "failed"
        else:
            return out
        return [*out, (at, self.state, self.attempts, kind)]


def lease_changes(events: DataFrame, key: str, delay: str = "0 seconds", seconds: int = 300, max_attempts: int = 3) -> DataFrame:
    """key, at, state, attempts, reason: every change of a job's state; run it in append mode.

    events: a stream of key, id, at (timestamp), kind. enqueue makes a job that is new or
    ended queued; lease takes a queued or retryable one, max_attempts times at most; renew
    lengthens a lease; complete and fail end it. Other events change nothing. A lease that is
    not ended after `seconds` makes its job retryable again, at its end: by the job's next
    event, or by its timer once the watermark, `delay` behind the last event of all, has
    passed it. Rows later than the delay are dropped; times count in whole seconds.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = _Job(*state.get) if state.exists else _Job()
        if state.hasTimedOut:
            out = job.expire(job.until + 1)
        else:
            rows = pd.concat([f[["second", "id", "kind"]] for f in frames]).sort_values(["second", "id"])
            out = [x for at, what in zip(rows["second"].tolist(), rows["kind"], strict=True) for x in job.step(at, what, seconds, max_attempts)]
        now = state.getCurrentWatermarkMs()
        if job.state == "leased" and job.until * 1000 < now:
            out += job.expire(job.until + 1)
        state.update((job.state, job.attempts, job.until))
        if job.state == "leased":
            state.setTimeoutTimestamp(max(job.until * 1000, now + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), **{c: [x[i] for x in out] for i, c in enumerate(("at", "state", "attempts", "reason"))}})

    rows = events.select(key, "id", "at", F.unix_seconds("at").alias("second"), "kind").withWatermark("at", delay)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {_CHANGE}", "state string, attempts long, until long", "append", GroupStateTimeout.EventTimeTimeout)


def lease_changes_batch(events: DataFrame, key: str, until: int, seconds: int = 300, max_attempts: int = 3) -> DataFrame:
    """The same over a table, leases that end before `until` (epoch seconds) expired: one ordered pass over each job's events, row by row."""
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, job = None, None

        def packed(rows: list[tuple], schema: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (schema, pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=[key, "at", "state", "attempts", "reason"])

        schema = None
        for b in batches:
            out, schema = [], b.schema.field(0).type
            for k, t, what in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                if job is None or k != at:
                    if job is not None:
                        out += [(at, *x) for x in job.expire(until)]
                    at, job = k, _Job()
                out += [(k, *x) for x in job.step(t, what, seconds, max_attempts)]
            yield packed(out, schema)
        if job is not None:
            yield packed([(at, *x) for x in job.expire(until)], schema)

    rows = events.select(key, F.unix_seconds("at").alias("at"), "kind", "id").repartition(key).sortWithinPartitions(key, "at", "id")
    return rows.mapInArrow(run, f"{key} {kind}, {_CHANGE}")


def assign(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (id, at) with the job that each gets: the first claim the head of the queue, the second the next, and so on; null if none is left.

    jobs: id, state, attempts, max_attempts, due and priority, created. Eligible are queued,
    retryable and budget-blocked jobs with attempts left that are due by the time of
    the earliest claim (null: at once); they go by priority, age and id. Both sides are
    numbered in ranges and joined by number, so no task holds the whole queue.
    """
    first = claims.agg(F.min("at").alias("_first"))
    ok = F.col("state").isin("queued", "retryable", "budget_blocked") & (F.col("attempts") < F.col("max_attempts")) & (F.col("due").isNull() | (F.col("due") <= F.col("_first")))
    ready = jobs.join(F.broadcast(first)).where(ok).select(F.col("id").alias("job_id"), "priority", "created")  # one row
    queue = running(ready, [], [F.col("priority"), F.col("created"), F.col("job_id")], {"_n": ("count", None)}).select("job_id", "_n")
    asked = running(claims, [], [F.col("at"), F.col("id")], {"_n": ("count", None)})
    return asked.join(queue, "_n", "left").drop("_n")
