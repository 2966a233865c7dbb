"""Registered queries of what stores exchange and of the steps from an article to its output, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_values as J
from ..functions import rules as R
from ..operators import exports, subsets, workflow
from ..session import table
from .registry import query

_ARTIFACTS = """(SELECT conv_id * 1000 + turn AS id, conv_id AS article_id, CASE WHEN turn % 2 = 0 THEN 'translation' ELSE 'summary' END AS task_type, 'zh-CN' AS target_language, CASE WHEN turn % 7 = 6 THEN 'failed' ELSE 'succeeded' END AS status, 'h' || CASE WHEN conv_id % 10 = 3 THEN 9 ELSE conv_id % 7 END AS hash, '2024-01-01T00:00:0' || turn % 3 || 'Z' AS created_at, CASE WHEN turn % 3 = 1 THEN 'publisher' ELSE 'p1' END AS provider, substr(sha256(coalesce(text, '')), 1, 8) AS title, conv_id % 13 = 5 AS broken FROM conversations)"""
_NEWEST = f"(SELECT * FROM (SELECT a.*, d.source, d.doc_id, d.lang, row_number() OVER (PARTITION BY article_id, d.source, task_type ORDER BY created_at DESC, id DESC) AS nth FROM {_ARTIFACTS} a JOIN documents d ON d.doc_id = a.article_id AND 'h' || d.doc_id % 7 = a.hash WHERE status = 'succeeded') WHERE nth = 1)"


def _artifacts(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id")
    title = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8)
    output = F.when(conv % 13 == 5, "{").otherwise(F.concat(F.lit('{ "title": "'), title, F.lit('", "language": "zh-CN"}')))
    return table(spark, d, "conversations").select(
        (conv * 1000 + turn).alias("id"), conv.alias("article_id"), F.when(turn % 2 == 0, "translation").otherwise("summary").alias("task_type"), F.lit("zh-CN").alias("target_language"), F.when(turn % 7 == 6, "failed").otherwise("succeeded").alias("status"), F.lit("metadata").alias("input_scope"), F.lit(None).cast("long").alias("source_artifact_id"), F.lit(None).cast("long").alias("content_snapshot_id"),
        F.concat(F.lit("h"), F.when(conv % 10 == 3, 9).otherwise(conv % 7).cast("string")).alias("article_content_hash"), F.concat(F.lit("2024-01-01T00:00:0"), (turn % 3).cast("string"), F.lit("Z")).alias("created_at"), F.when(turn % 3 == 1, "publisher").otherwise("p1").alias("provider"), F.lit("ph").alias("prompt_hash"), output.alias("output"),
    )


def _articles(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("id"), F.col("source").alias("source_slug"), F.concat(F.lit("e"), i.cast("string")).alias("external_id"), F.concat(F.lit("https://x.org/"), i.cast("string")).alias("canonical_url"), F.concat(F.lit("h"), (i % 7).cast("string")).alias("content_hash"))


_PUBLISHER = "sha256('publisher')"
_OUTPUT = """'{"language":"zh-CN","title":"' || title || '"}'"""
_PROMPT = f"CASE WHEN provider = 'publisher' THEN {_PUBLISHER} ELSE 'ph' END"


@query(f"""SELECT 'e' || doc_id AS external_id, task_type, created_at, provider, {_PROMPT} AS prompt_hash, sha256({_OUTPUT}) AS output_hash,
sha256('{{"canonical_url":"https://x.org/' || doc_id || '","content_hash":"' || hash || '","created_at":"' || created_at || '","external_id":"e' || doc_id || '","output":' || {_OUTPUT} || ',"output_hash":"' || sha256({_OUTPUT}) || '","prompt_hash":"' || {_PROMPT} || '","provider":"' || provider || '","source_slug":"' || source || '","target_language":"zh-CN","task_type":"' || task_type || '"}}') AS cache_key
FROM {_NEWEST} n WHERE source IS NOT NULL AND NOT broken""")
def exported_artifacts(spark, d):
    """The newest output of each article and task that was made from what the article says now, under portable names and keys."""
    articles = _articles(spark, d)
    sources = articles.where("source_slug IS NOT NULL").select(F.col("source_slug").alias("slug")).distinct().withColumn("name", F.upper("slug"))
    rows = exports.exportable(_artifacts(spark, d), articles, sources)
    return exports.published_artifacts(rows, ["created_at", "provider", "prompt_hash", "output"]).select("external_id", "task_type", "created_at", "provider", "prompt_hash", "output_hash", "cache_key")


@query(f"SELECT article_id, task_type, id FROM {_NEWEST} n WHERE NOT broken AND title < 'c'")
def current_artifacts(spark, d):
    """Articles' current outputs: the newest of any provider, if it is valid."""
    valid = F.get_json_object("output", "$.title") < "c"
    return exports.current_artifact(_artifacts(spark, d), _articles(spark, d), valid).select("article_id", "task_type", "id")


_HOLD = """'{"article":"a' || user_id || '"' || CASE WHEN event_id % 11 = 3 THEN ',"deep":[{"prompt":"x"}]' ELSE '' END || ',"task":"' || event_type || '"}'"""


@query(f"SELECT CASE WHEN event_id % 5 = 4 THEN sha256('other') ELSE sha256({_HOLD}) END AS hold_key, event_type AS workload_kind, CASE WHEN event_id % 17 = 1 THEN 'no JSON object' WHEN event_id % 11 = 3 THEN 'forbidden member' WHEN event_id % 5 = 4 THEN 'another key' END AS error, CASE WHEN event_id % 17 <> 1 THEN {_HOLD} END AS descriptor, CAST(event_id AS BIGINT) AS revision FROM events")
def exported_holds(spark, d):
    i = F.col("event_id")
    deep = F.when(i % 11 == 3, F.lit(', "deep": [ {"prompt":"x"} ]')).otherwise("")
    text = F.concat(F.lit('{"task": "'), F.col("event_type"), F.lit('"'), deep, F.lit(', "article":"a'), F.col("user_id").cast("string"), F.lit('"}'))
    key = F.when(i % 5 == 4, F.sha2(F.lit("other"), 256)).otherwise(exports.hold_key(text))
    holds = table(spark, d, "events").select(key.alias("hold_key"), F.col("event_type").alias("workload_kind"), F.lit("ambiguous").alias("hold_class"), F.when(i % 17 == 1, F.lit("[1]")).otherwise(text).alias("descriptor"), F.lit("t").alias("created_at"), F.lit("t").alias("updated_at"), i.alias("revision"))
    out = exports.hold_rows(holds, ("prompt", "response"), with_revision=True)
    return out.select("hold_key", "workload_kind", "error", F.when(F.col("error").isNull() | (F.col("error") != "no JSON object"), F.col("descriptor")).alias("descriptor"), "revision").withColumn("hold_key", F.coalesce("hold_key", F.lit("")))


@query("""SELECT o_orderkey, '{"article_identity":{"id":"c' || o_custkey || '"},"note":"x","parts":[{"article_identity":{"id":"c' || o_orderkey || '"},"text":"t"},{"article":1}]}' AS portable FROM orders WHERE o_custkey <> o_orderkey
UNION ALL SELECT o_orderkey, '{"article_identity":{"id":"c' || o_custkey || '"},"note":"x","parts":[{"article_identity":{"id":"c' || o_custkey || '"},"text":"t"},{"article":1}]}' FROM orders WHERE o_custkey = o_orderkey""")
def portable_inputs(spark, d):
    """Nested inputs whose local ids give way to identities."""
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    text = F.concat(F.lit('{"parts": [{"text": "t", "article_id": '), b.cast("string"), F.lit('}, {"article_id": "no id", "article": 1}], "note": "x", "article_id": '), a.cast("string"), F.lit("}"))
    one = lambda c: F.concat(F.lit('{"id": "c'), c.cast("string"), F.lit('"}'))
    known = F.map_from_entries(F.array_distinct(F.array(*[F.struct(c.alias("k"), one(c).alias("v")) for c in (a, b)])))
    return table(spark, d, "orders").select("o_orderkey", J.portable(text, "article_id", "article_identity", known).alias("portable"))


_FIELDS = ("name has a control character", "name has a bad length", "name is no text", "name is not composed", "key is no digest", "key has a bad length", "at is no time", "language is no language", "n is out of range", "n is no number", "state is unknown")


@query(f"SELECT event_id, {list(_FIELDS)}[event_id % 13 + 1] AS error FROM events WHERE event_id % 13 < {len(_FIELDS)}")
def field_gates(spark, d):
    """Each event's row breaks one rule or none."""
    k, i = F.col("event_id") % 13, F.col("event_id")
    bad = lambda n, value, good: F.when(k == n, value).otherwise(good)
    name = F.when(k == 0, "a\x85b").when(k == 1, F.repeat(F.lit("x"), 41)).when(k == 3, "é").when(k != 2, F.concat(F.lit("é"), i.cast("string")))
    key = bad(4, F.repeat(F.lit("G"), 64), bad(5, F.lit(""), F.sha2(i.cast("string"), 256)))
    rows = table(spark, d, "events").select("event_id", name.alias("name"), key.alias("key"), bad(6, "2024-02-30T00:00:00Z", F.lit("2024-02-28T00:00:00Z")).alias("at"), bad(7, "zh_cn", F.lit("zh-CN")).alias("language"), F.when(k == 8, -1).when(k != 9, i).alias("n"), bad(10, "odd", F.lit("queued")).alias("state"))
    out = R.violations(rows, R.text(F.col("name"), "name", 40), R.digest(F.col("key"), "key"), R.time(F.col("at"), "at"), R.language(F.col("language"), "language"), R.whole(F.col("n"), "n"), R.one_of(F.col("state"), "state", workflow.OPEN))
    return out.select("event_id", "error")


_STEPS = """(SELECT user_id, date_trunc('day', ts) AS day, bool_or(event_type = 'view' AND value > 90) AS have, bool_or(event_type = 'error') AS amb, bool_or(event_type = 'signup') AS paid,
  arg_max(event_id % 6, event_id) FILTER (event_type = 'purchase') AS job, bool_or(event_id % 9 = 1) AS force, bool_or(event_id % 4 = 1) AS retry FROM events GROUP BY 1, 2)"""


@query(f"""SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN have THEN 'cached' WHEN amb AND NOT force THEN 'held_ambiguous' WHEN paid AND NOT force AND NOT retry THEN 'held_paid' WHEN job IS NULL THEN 'enqueue'
WHEN job = 0 THEN 'requeue' WHEN job = 1 THEN CASE WHEN force THEN 'requeue' ELSE 'refused' END WHEN job = 2 THEN CASE WHEN force OR (retry AND paid AND NOT amb) THEN 'requeue' ELSE 'refused' END WHEN job IN (3, 4) THEN 'run' ELSE 'refused' END AS step FROM {_STEPS} s""")
def next_steps(spark, d):
    """What a request of each user and day would do, by that day's outputs, holds and jobs."""
    e = table(spark, d, "events").withColumn("key", F.struct("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")))
    t, i = F.col("event_type"), F.col("event_id")
    requests = e.groupBy("key").agg(F.bool_or(i % 9 == 1).alias("force"), F.bool_or(i % 4 == 1).alias("retry_paid"))
    current = e.where((t == "view") & (F.col("value") > 90))
    holds = e.where(t.isin("error", "signup") | ((t == "view") & (F.col("value") <= 90))).select("key", F.when(t == "error", "ambiguous").when(t == "signup", "paid_failure").otherwise("fallback_pending").alias("hold_class"))
    states = F.array(*[F.lit(x) for x in ("cancelled", "unknown", "permanent_failed", "queued", "retryable", "succeeded")])
    jobs = e.where(t == "purchase").groupBy("key").agg(F.element_at(states, (F.max_by(i % 6, i) + 1).cast("int")).alias("state"))
    return workflow.next_steps(requests, current, holds, jobs, "key").select("key.user_id", "key.day", "step")


@query("""WITH s AS (SELECT o_custkey AS k, min('c' || o_orderkey % 400) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), g AS (SELECT o_orderkey, o_custkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN 'c' || o_orderkey % 400 END AS c FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, CASE WHEN c IS NOT NULL AND CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.c = g.c) THEN NOT EXISTS (SELECT 1 FROM s WHERE s.c = g.c AND s.k = g.k AND s.k = (SELECT max(k) FROM s AS z WHERE z.c = g.c)) ELSE k > (SELECT min(k) FROM g AS z WHERE z.c = g.c) END THEN 'rebound'
  WHEN EXISTS (SELECT 1 FROM s WHERE s.k = g.k) OR coalesce(c, '') <> (SELECT min(coalesce(c, '')) FROM g AS z WHERE z.k = g.k) THEN 'present' ELSE 'queued' END AS outcome FROM g""")
def enqueued_jobs(spark, d):
    """Filled orders are jobs that customers have; the others ask for one, some under client ids that belong to another customer."""
    o = table(spark, d, "orders")
    client = F.concat(F.lit("c"), (F.col("o_orderkey") % 400).cast("string"))
    first = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min(client).alias("client"))
    jobs = first.groupBy("client").agg(F.max("o_custkey").alias("o_custkey")).unionByName(first.select("o_custkey", F.lit(None).cast("string").alias("client")))  # a client id has one owner
    given = o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 > 0, client).alias("client"))
    return workflow.enqueue(jobs, given, "o_custkey", "client").select("o_orderkey", "outcome")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL OR c_mktsegment = 'MACHINERY' THEN 'gone' WHEN c_mktsegment = 'BUILDING' THEN 'article' WHEN o_orderkey % 4 = 1 THEN 'input' WHEN o_orderkey % 4 = 2 THEN 'configuration' END AS drift FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def job_drift(spark, d):
    """What has changed since a job was queued."""
    c, k = table(spark, d, "customer"), F.col("o_orderkey") % 4
    jobs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("article_id"), F.lit("h").alias("content_hash"), F.lit("i").alias("input_hash"), F.lit("a").alias("artifact_key"))
    articles = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", "h").alias("content_hash"))
    prepared = jobs.select("o_orderkey", F.when(k == 1, "j").otherwise("i").alias("input_hash"), F.when(k == 2, "b").otherwise("a").alias("artifact_key"))
    return workflow.drift(jobs, articles, prepared, "o_orderkey").select("o_orderkey", "drift")


@query("""WITH o AS (SELECT doc_id, t AS task, CASE WHEN doc_id % 9 = 1 THEN 'unknown_request' WHEN t = 'translation' AND doc_id % 2 = 0 THEN 'not_asked' WHEN doc_id % 9 = 2 THEN 'stale' WHEN doc_id % 9 = 4 THEN 'broken' WHEN doc_id % 9 = 5 AND t = 'summary' THEN 'present' ELSE 'refused' END AS outcome FROM (SELECT DISTINCT doc_id FROM documents), (VALUES ('summary'), ('translation')) v(t))
SELECT *, CASE WHEN outcome IN ('present', 'refused') THEN CASE task WHEN 'summary' THEN 's' || doc_id ELSE 't' || chr(10) || chr(10) END END AS readable FROM o""")
def imported_results(spark, d):
    """Two results for each document, with faults of every kind in the batch: nothing new is stored."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id").distinct()
    asked = F.when(i % 2 == 0, F.array(F.lit("summary"))).otherwise(F.array(F.lit("summary"), F.lit("translation")))
    rows = docs.withColumn("task", F.explode(F.array(F.lit("summary"), F.lit("translation"))))
    short = F.concat(F.lit('{"summary":"s'), i.cast("string"), F.lit('","key_points":[],"language":"zh-CN","basis":"metadata","limitations":""}'))
    whole = F.lit('{"title":"t","publisher_summary":null,"language":"zh-CN","limitations":""}')
    output = F.when(i % 9 == 4, F.lit("{}")).when(F.col("task") == "summary", short).otherwise(whole)
    results = rows.select(i.alias("item"), i.cast("string").alias("base"), subsets.set_fingerprint(F.when(i % 9 == 1, -i).otherwise(i), asked).alias("fingerprint"), i.alias("article_id"), F.when(i % 9 == 2, "old").otherwise("now").alias("content_hash"), "task", output.alias("output"))
    stored = docs.where(i % 9 == 5).select(i.alias("article_id"), F.lit("summary").alias("task"), F.lit("now").alias("content_hash"))
    out = workflow.import_results(results, docs.select(i.alias("id"), F.lit("now").alias("content_hash")), stored, ["summary", "translation"], "zh-CN")
    return out.select(F.col("item").alias("doc_id"), "task", "outcome", "readable")


@query("SELECT o_orderkey, coalesce(c_name, s_name, n_name) AS name, CASE WHEN c_custkey IS NOT NULL THEN 0 WHEN s_suppkey IS NOT NULL THEN 1 WHEN n_nationkey IS NOT NULL THEN 2 END AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey")
def first_known_names(spark, d):
    """A name for each order's number from the first of three tables that has it."""
    key = lambda t, k, n: table(spark, d, t).select(F.col(k).alias("o_custkey"), F.col(n).alias("name"), "*")
    tables = [key("customer", "c_custkey", "c_name").where("c_mktsegment = 'BUILDING'"), key("supplier", "s_suppkey", "s_name"), key("nation", "n_nationkey", "n_name")]
    return workflow.first_known(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", tables, ["name"]).select("o_orderkey", "name", "found")


@query("SELECT c_custkey, count(o_orderkey) AS n_pending FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY 1")
def pending_counts(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return workflow.pending_counts(table(spark, d, "customer").select("c_custkey"), pending, "c_custkey")
