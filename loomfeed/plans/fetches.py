"""Registered queries over recorded responses, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fetching
from ..session import table
from .registry import _ts, query

# page n answers under /p/n: most are pages, some lead on to the next page, back, away, or fail
_RULE = "CASE WHEN page_id % 50 = 13 THEN 'away' WHEN page_id % 50 = 7 THEN 'back' WHEN page_id % 50 = 27 THEN 'nowhere' WHEN page_id % 50 BETWEEN 30 AND 38 OR page_id % 5 IN (1, 2) THEN 'next' WHEN page_id % 10 = 8 THEN 'gone' WHEN page_id % 10 = 9 THEN 'image' ELSE 'page' END"


@query(f"""WITH RECURSIVE r AS (SELECT page_id, {_RULE} AS rule, length(html) AS n FROM pages),
f AS (SELECT page_id AS id, page_id AS cur, []::BIGINT[] AS seen, 0 AS hops, 'go' AS outcome FROM r
  UNION ALL
  SELECT f.id, CASE WHEN x = 'go' THEN CASE r.rule WHEN 'back' THEN cur - 1 ELSE cur + 1 END WHEN x = 'not_allowed' THEN cur ELSE cur END, list_append(seen, cur), hops + CASE WHEN x IN ('go', 'not_allowed') THEN 1 ELSE 0 END, x
  FROM (SELECT f.*, r.rule, CASE WHEN list_contains(seen, cur) THEN 'loop' WHEN r.rule IS NULL THEN 'no_response' WHEN r.rule = 'nowhere' THEN 'no_location' WHEN r.rule IN ('next', 'back', 'away') AND hops >= 5 THEN 'too_many_redirects' WHEN r.rule = 'away' THEN 'not_allowed' WHEN r.rule IN ('next', 'back') THEN 'go' WHEN r.rule = 'gone' THEN 'status_410' WHEN r.rule = 'image' THEN 'content_type' WHEN r.n > 4000 THEN 'too_large' ELSE 'ok' END AS x FROM f LEFT JOIN r ON r.page_id = f.cur WHERE f.outcome = 'go') f LEFT JOIN r ON r.page_id = f.cur)
SELECT id, CASE WHEN outcome = 'not_allowed' THEN 'https://elsewhere.org/x' ELSE 'https://x.org/p/' || cur END AS final_url, hops, outcome FROM f WHERE outcome <> 'go'""")
def followed_redirects(spark, d):
    """Where the recorded responses of all pages lead, five redirects at most."""
    p, i = table(spark, d, "pages"), F.col("page_id")
    rule = F.expr(_RULE)
    at = lambda x: F.concat(F.lit("https://x.org/p/"), x.cast("string"))
    location = F.when(rule == "away", "//elsewhere.org/x#y").when(rule == "back", F.concat(F.lit("../p/"), (i - 1).cast("string"))).when(rule == "next", F.concat(F.lit("/p/"), (i + 1).cast("string")))
    status = F.when(rule.isin("away", "back", "next", "nowhere"), 302).when(rule == "gone", 410).otherwise(200)
    responses = p.select(at(i).alias("url"), status.alias("status"), location.alias("location"), F.when(rule == "image", "image/png").otherwise("Text/HTML; charset=utf-8").alias("content_type"), F.lit("identity").alias("content_encoding"), F.lit(None).cast("string").alias("content_length"), F.length("html").alias("n_bytes"))
    requests = p.select(i.alias("id"), F.concat(F.lit("HTTPS://X.org:443/p/"), i.cast("string"), F.lit("#top")).alias("url"), F.array(F.lit("x.org")).alias("hosts"))
    return fetching.followed(requests, responses, "hosts", most_bytes=4000)


@query("SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'not_modified' WHEN event_id % 8 IN (1, 2) THEN 'ok' WHEN event_id % 8 IN (3, 4) AND event_id % 3 = 1 AND (event_id % 5 = 0 OR event_id % 20 <= 10) THEN 'retry' ELSE 'failed' END AS step FROM events")
def response_steps(spark, d):
    i = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in (304, 200, 206, 503, 429, 404, 501, 301)]), (i % 8 + 1).cast("int"))
    wait = F.when(i % 5 > 0, (i % 20).cast("double"))
    return table(spark, d, "events").select("event_id", fetching.response_step(status, wait, i % 3 + F.when(i % 3 == 0, 5).otherwise(0)).alias("step"))


@query("""WITH s AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id, arg_max(event_type, (ts, event_id)) AS t FROM events WHERE event_type <> 'purchase' GROUP BY 1)
SELECT c_custkey AS article_id, CASE WHEN t IN ('view', 'click') AND c_custkey % 6 <> 5 THEN id END AS snapshot_id, CASE WHEN t IN ('view', 'click') AND c_custkey % 6 <> 5 THEN 'cached' ELSE 'fetch_and_store' END AS step FROM customer LEFT JOIN s ON user_id = c_custkey""")
def content_reads(spark, d):
    """Which articles the newest snapshot serves: views and clicks are of the current extractor and URL; purchases are no snapshots."""
    e, t = table(spark, d, "events"), F.col("event_type")
    url = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    snapshots = e.where("event_type <> 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("article_id"), _ts("ts").alias("retrieved_at"), F.when(t == "error", "old").otherwise(url).alias("canonical_url"), F.when(t == "signup", "v1").otherwise("v2").alias("extractor_version"))
    k = F.col("c_custkey")
    requests = table(spark, d, "customer").select(k.alias("article_id"), F.concat(F.lit("u"), k.cast("string")).alias("url"), (k % 6 == 5).alias("refresh"))
    return fetching.read_through(requests, snapshots, "fetch_on_demand_cached_local", "v2").select("article_id", "snapshot_id", "step")
