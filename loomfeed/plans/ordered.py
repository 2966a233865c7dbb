"""Registered queries of ordered decisions: reservations, leases, schedules; with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import utc_text
from ..operators import admission, intervals, scan
from ..session import table
from .registry import _ts, query

_LA_DAY = "CAST(timezone('America/Los_Angeles', timezone('UTC', {})) AS DATE)"
_LA_UTC = "timezone('UTC', timezone('America/Los_Angeles', CAST({} AS TIMESTAMP)))"

_LIMITS = admission.Limits(daily_requests=3, daily_tokens=1500, monthly_requests=40, monthly_tokens=11000, daily_cost=170, monthly_cost=2500)
_JOBS = ("click", "error", "purchase", "signup", "view")

# one row a scope and step: totals of the day and the month, attempts of the five jobs (100: ended), open reservations
_ADMIT = f"""
WITH RECURSIVE r AS (SELECT event_id AS id, user_id AS s, list_position({list(_JOBS)}, event_type) AS job, event_type AS name, ts, {_LA_DAY.format("ts")} AS day, CAST(ceil(value * 6) AS BIGINT) AS tokens, event_id % 97 AS cost, event_type = 'view' AND event_id % 5 = 0 AS cached FROM events),
e AS (SELECT *, date_trunc('month', day)::DATE AS mon, 1 AS kind FROM r UNION ALL
      SELECT id, s, job, name, ts + INTERVAL 5 HOUR, day, tokens // 3, cost // 2, cached, date_trunc('month', day)::DATE, 2 FROM r
      WHERE name IN ('click', 'purchase') AND date_trunc('month', {_LA_DAY.format("ts + INTERVAL 5 HOUR")}) = date_trunc('month', day)),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts, kind, id) AS n FROM e),
f AS (
  SELECT DISTINCT s, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::DATE AS day, NULL::DATE AS mon, 0::BIGINT AS dr, 0::BIGINT AS dt, 0::BIGINT AS dc, 0::BIGINT AS mr, 0::BIGINT AS mt, 0::BIGINT AS mc, [0, 0, 0, 0, 0]::BIGINT[] AS tries, []::BIGINT[] AS held, NULL::VARCHAR AS decision, NULL::VARCHAR AS reason, NULL::TIMESTAMP AS next_attempt, NULL::BIGINT AS attempt FROM o
  UNION ALL
  SELECT s, n, id, CASE WHEN kind = 1 THEN day ELSE oday END, CASE WHEN kind = 1 THEN mon ELSE omon END,
    dr + CASE WHEN ok THEN 1 ELSE 0 END, dt + CASE WHEN ok THEN tokens WHEN back AND day = oday THEN tokens - was_t ELSE 0 END, dc + CASE WHEN ok THEN cost WHEN back AND day = oday THEN cost - was_c ELSE 0 END,
    mr + CASE WHEN ok THEN 1 ELSE 0 END, mt + CASE WHEN ok THEN tokens WHEN back THEN tokens - was_t ELSE 0 END, mc + CASE WHEN ok THEN cost WHEN back THEN cost - was_c ELSE 0 END,
    CASE WHEN kind = 1 THEN list_transform(tries, lambda x, i: CASE WHEN i <> job THEN x WHEN ok THEN x + 1 WHEN decision IN ('impossible', 'attempt_limit') THEN 100 ELSE x END) ELSE tries END,
    CASE WHEN ok THEN list_append(held, id) ELSE held END, decision, reason,
    CASE WHEN decision = 'blocked' THEN greatest(CASE WHEN lr = 'd' OR lt = 'd' OR lc = 'd' THEN {_LA_UTC.format("(day + 1)")} END, CASE WHEN lmr OR lmt OR lmc THEN {_LA_UTC.format("(mon + INTERVAL 1 MONTH)")} END) END,
    CASE WHEN ok THEN tries[job] + 1 END
  FROM (SELECT *, kind = 1 AND decision = 'admitted' AS ok, kind = 2 AND list_contains(held, id) AS back FROM (
    SELECT *, CASE WHEN kind = 2 THEN NULL WHEN cached THEN 'cached' WHEN tries[job] = 100 THEN 'conflict' WHEN tries[job] >= 6 THEN 'attempt_limit' WHEN never IS NOT NULL THEN 'impossible' WHEN later IS NOT NULL THEN 'blocked' ELSE 'admitted' END AS decision,
      CASE WHEN kind = 2 OR cached THEN NULL WHEN tries[job] = 100 THEN 'ended' WHEN tries[job] >= 6 THEN 'attempts' ELSE coalesce(never, later) END AS reason
    FROM (SELECT *, CASE WHEN tokens > 1500 THEN 'daily_tokens' WHEN tokens > 11000 THEN 'monthly_tokens' WHEN cost > 170 THEN 'daily_cost' WHEN cost > 2500 THEN 'monthly_cost' END AS never,
        CASE WHEN lr = 'd' THEN 'daily_requests' WHEN lt = 'd' THEN 'daily_tokens' WHEN lmr THEN 'monthly_requests' WHEN lmt THEN 'monthly_tokens' WHEN lc = 'd' THEN 'daily_cost' WHEN lmc THEN 'monthly_cost' END AS later
      FROM (SELECT *, CASE WHEN dr + 1 > 3 THEN 'd' END AS lr, CASE WHEN dt + tokens > 1500 THEN 'd' END AS lt, mr + 1 > 40 AS lmr, mt + tokens > 11000 AS lmt, CASE WHEN dc + cost > 170 THEN 'd' END AS lc, mc + cost > 2500 AS lmc
        FROM (SELECT o.*, f.day AS oday, f.mon AS omon, tries, held,
            CASE WHEN kind = 2 OR o.day = f.day THEN dr ELSE 0 END AS dr, CASE WHEN kind = 2 OR o.day = f.day THEN dt ELSE 0 END AS dt, CASE WHEN kind = 2 OR o.day = f.day THEN dc ELSE 0 END AS dc,
            CASE WHEN kind = 2 OR o.mon = f.mon THEN mr ELSE 0 END AS mr, CASE WHEN kind = 2 OR o.mon = f.mon THEN mt ELSE 0 END AS mt, CASE WHEN kind = 2 OR o.mon = f.mon THEN mc ELSE 0 END AS mc,
            r.tokens AS was_t, r.cost AS was_c FROM f JOIN o ON o.s = f.s AND o.n = f.n + 1 JOIN r ON r.id = o.id))))))
SELECT s::VARCHAR AS scope, id, r.name AS job, decision, reason, strftime(next_attempt, '%Y-%m-%dT%H:%M:%SZ') AS next_attempt, attempt FROM f JOIN r USING (s, id) WHERE decision IS NOT NULL"""


@query(_ADMIT)
def ordered_admission(spark, d):
    """Every event asks for a reservation; clicks and purchases settle after five hours."""
    e = table(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("id"), F.col("event_type").alias("job"), _ts("ts").alias("ts"), F.ceil(F.col("value") * 6).alias("tokens"), (F.col("event_id") % 97).alias("cost"), ((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0)).alias("cached"))
    settled = e.where(F.col("job").isin("click", "purchase")).select("id", (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("at"), F.expr("tokens DIV 3").alias("tokens"), F.expr("cost DIV 2").alias("cost"))
    return admission.admit(e, _LIMITS, settled, max_attempts=6).withColumn("next_attempt", utc_text(F.col("next_attempt")))


_SPANS = "(SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * value) AS BIGINT) AS e FROM events)"


def _spans(spark, d):
    """Every event as an interval of whole seconds; some are empty, some last for days."""
    s = F.unix_seconds(_ts("ts"))
    return table(spark, d, "events").select("event_id", "user_id", s.alias("s"), (s + F.floor(F.col("value") * F.col("value"))).alias("e"))


@query(f"SELECT a.user_id, a.event_id, b.event_id AS event_id_r FROM {_SPANS} a JOIN {_SPANS} b ON a.user_id = b.user_id AND a.event_id < b.event_id AND greatest(a.s, b.s) < least(a.e, b.e)")
def overlapping_intervals(spark, d):
    """Pairs of a user's events whose intervals overlap."""
    rows = _spans(spark, d)
    return intervals.overlap_join(rows, rows, "s", "e", ["user_id"]).where("event_id < event_id_r").select("user_id", "event_id", "event_id_r")


@query(f"WITH x AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {_SPANS} t WHERE e > s), y AS (SELECT *, sum(CASE WHEN far IS NULL OR far < s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS run FROM x) SELECT user_id, min(s) AS s, max(e) AS e FROM y GROUP BY user_id, run")
def merged_intervals(spark, d):
    return intervals.merged(_spans(spark, d), "s", "e", ["user_id"])


@query(f"WITH w AS (SELECT user_id % 15 AS g, s, e, s + (e - s) // 2 AS through FROM {_SPANS} t), p AS (SELECT event_id, user_id % 15 AS g, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events) SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.g = p.g AND p.at >= w.s AND p.at < w.e AND p.at <= w.through)")
def outside_intervals(spark, d):
    """Events that no counted window of their group of users holds; a window counts up to its middle."""
    w = _spans(spark, d).select((F.col("user_id") % 15).alias("g"), "s", "e", (F.col("s") + F.expr("(e - s) DIV 2")).alias("through"))
    p = _spans(spark, d).select("event_id", (F.col("user_id") % 15).alias("g"), F.col("s").alias("at"))
    return intervals.not_inside(p, w, "at", "s", "e", "through", ["g"]).select("event_id")


@query("SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS most, count(*) OVER w AS n, lag(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS previous FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, d):
    """Running values over the whole table in one order, without a partition of all rows."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", cents.alias("c"))
    out = scan.running(rows, [], [F.col("o_orderdate"), F.col("o_orderkey")], {"cents": ("sum", F.col("c")), "most": ("max", F.col("c")), "n": ("count", None), "previous": ("last", F.col("o_orderkey"))})
    return out.select("o_orderkey", "cents", "most", F.col("n").cast("long").alias("n"), "previous")
