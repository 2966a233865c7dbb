"""Registered queries that run as Structured Streaming over what is there, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import usage
from ..session import table
from ..streaming import leases, state
from ..streaming import usage as usage_stream
from .registry import _DAILY, _attempts, _ts, attempts_of, query


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a stream's source must be a folder or a pattern; this one is the file or folder itself
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_seen_dedup(spark, d):
    e = _stream(spark, d, "events").select("user_id", "event_type")
    return state.drained(state.seen_dedup(e, ["user_id", "event_type"]), "seen").drop("batch")


_QUEUE = "WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type <> 'error' AS ok FROM events), k AS (SELECT user_id, max(t) AS last, coalesce(max(t) FILTER (ok), -1) AS ok_at FROM e GROUP BY 1), n AS (SELECT k.user_id, last, count(*) FILTER (NOT ok AND t > ok_at) AS attempts FROM k JOIN e USING (user_id) GROUP BY 1, 2) SELECT user_id, attempts, CASE WHEN attempts > 0 THEN CAST(last + least(21600, 60 * power(2, least(attempts - 1, 8))) AS BIGINT) END AS due FROM n"


def _outcomes(df):
    return df.select("user_id", F.unix_seconds(_ts("ts")).alias("at"), (F.col("event_type") != "error").alias("ok"))


@query(_QUEUE)
def stream_retry_queue(spark, d):
    queue = state.retry_queue(_outcomes(_stream(spark, d, "events")), "user_id")
    return state.latest(state.drained(queue, "queue", "update"), "user_id")


@query(_QUEUE)
def retry_queue_batch(spark, d):
    return state.retry_queue_batch(_outcomes(table(spark, d, "events")), "user_id")


@query(_DAILY)
def stream_daily_usage(spark, d):
    """Half of the days are carried up to 15:00 UTC; the stream adds the rest. Together they are the roll-up of all events, nothing lost or counted twice."""
    a = _attempts(spark, d).withColumn("day", V.civil_day(F.col("started")))
    covered = F.timestamp_seconds(F.unix_timestamp(V.day_bounds(F.col("day"))[0]) + 50400)
    early = a.where((F.dayofmonth("day") % 2 == 0) & (F.col("started") <= covered)).drop("day")
    ledger = usage.daily_rollup(early).withColumn("covered_through", covered)
    changes = state.drained(usage_stream.daily_usage(attempts_of(_stream(spark, d, "events")), ledger), "usage", "update")
    return usage_stream.settled_days(changes, ledger).withColumn("day", F.col("day").cast("string"))


_KIND = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'lease' WHEN 'view' THEN 'renew' WHEN 'purchase' THEN 'complete' ELSE 'fail' END"
_LEASE_SECONDS = 6 * 3600
_LEASES = f"""
WITH RECURSIVE o AS (SELECT user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events),
f AS (
  SELECT DISTINCT k, 0::BIGINT AS n, '' AS state, 0::BIGINT AS tries, 0::BIGINT AS til, NULL::BIGINT AS "at", NULL::VARCHAR AS reason, NULL::BIGINT AS ran_out, 0::BIGINT AS old_tries FROM o
  UNION ALL
  SELECT k, n, CASE WHEN hit THEN CASE kind WHEN 'enqueue' THEN 'queued' WHEN 'lease' THEN 'leased' WHEN 'complete' THEN 'succeeded' WHEN 'fail' THEN CASE WHEN tries < 3 THEN 'retryable' ELSE 'failed' END ELSE s END ELSE s END,
    CASE WHEN hit AND kind = 'enqueue' THEN 0 WHEN hit AND kind = 'lease' THEN tries + 1 ELSE tries END,
    CASE WHEN hit AND kind IN ('lease', 'renew') THEN t + {_LEASE_SECONDS} ELSE til END, t, CASE WHEN hit AND kind <> 'renew' THEN kind END, CASE WHEN over THEN til END, tries
  FROM (SELECT *, CASE kind WHEN 'enqueue' THEN s IN ('', 'succeeded', 'failed') WHEN 'lease' THEN s IN ('queued', 'retryable') AND tries < 3 ELSE s = 'leased' END AS hit
    FROM (SELECT o.*, tries, til, state = 'leased' AND til < t AS over, CASE WHEN state = 'leased' AND til < t THEN 'retryable' ELSE state END AS s FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)))
SELECT k AS user_id, "at", state, tries AS attempts, reason FROM f WHERE reason IS NOT NULL
UNION ALL SELECT k, ran_out, 'retryable', old_tries, 'lease_expired' FROM f WHERE ran_out IS NOT NULL
UNION ALL SELECT k, til, 'retryable', tries, 'lease_expired' FROM f WHERE state = 'leased' AND n = (SELECT max(n) FROM o WHERE o.k = f.k) AND til < (SELECT ceil(epoch(max(ts))) FROM events)"""


def _jobs(df):
    t = F.col("event_type")
    kind = F.when(t == "signup", "enqueue").when(t == "click", "lease").when(t == "view", "renew").when(t == "purchase", "complete").otherwise("fail")
    return df.select("user_id", F.col("event_id").alias("id"), _ts("ts").alias("at"), kind.alias("kind"))


@query(_LEASES)
def stream_leases(spark, d):
    changes = leases.lease_changes(_jobs(_stream(spark, d, "events")), "user_id", seconds=_LEASE_SECONDS)
    return state.drained(changes, "leases").drop("batch")


@query(_LEASES)
def lease_log(spark, d):
    jobs = _jobs(table(spark, d, "events"))
    end = jobs.agg(F.ceil(F.max(F.unix_micros("at")) / 1e6)).first()[0]
    return leases.lease_changes_batch(jobs, "user_id", end or 0, seconds=_LEASE_SECONDS)


@query("""WITH c AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'view'),
q AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey % 4 < 3 AND (o_custkey % 4 = 0 OR o_orderdate + INTERVAL 25 YEAR <= (SELECT min(ts) FROM events WHERE event_type <> 'view')))
SELECT event_id, o_orderkey AS job_id FROM c LEFT JOIN q USING (n)""")
def assigned_jobs(spark, d):
    """Every event but a view asks for a job; orders are the queue: finished ones, ones without attempts left and ones that are not due yet are passed over."""
    status, cust = F.col("o_orderstatus"), F.col("o_custkey")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(status == "O", "queued").when(status == "P", "retryable").otherwise("succeeded").alias("state"), (cust % 4).alias("attempts"), F.lit(3).alias("max_attempts"), F.when(cust % 4 > 0, F.col("o_orderdate") + F.expr("INTERVAL 25 YEARS")).alias("due"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created"))
    claims = table(spark, d, "events").where("event_type <> 'view'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return leases.assign(jobs, claims).select(F.col("id").alias("event_id"), "job_id")
