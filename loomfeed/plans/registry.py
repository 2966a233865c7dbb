"""The registered queries of the engine's own operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions import values as V
from ..operators import decisions, folds, joins, publish, state, usage
from ..session import table
from ..sources import feeds, html

FLAGSHIP = "source_status_rollup"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB twin."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _ts(c: str):
    return F.col(c).cast("timestamp")


def _text(c: str):
    return V.utc_text(_ts(c))


_UTC = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_CANON = r"""(regexp_extract(lower(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]+')), '^.*$') || CASE WHEN length(regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g')) > 1 THEN regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/$', '') ELSE '/' END || CASE WHEN q <> '' THEN '?' || q ELSE '' END)"""
_PAGES = rf"""(SELECT page_id, url, html, {_CANON} AS canonical FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(fbclid|gclid|mc_cid|mc_eid|ref|ref_src|utm_[^=]*)(=|$)')), '&') AS q FROM pages) AS s) AS p"""
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')"
_CLEAN = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F-\x{9F}]', ' ', 'g'), '[\s\p{Z}\x0b\x{85}]+', ' ', 'g'))"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# --- lists and searches -------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def list_newest_topk(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return folds.newest(rows, 100, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "c_name", _text("o_orderdate").alias("published"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def list_filtered(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    return folds.newest(rows, 50, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"SELECT doc_id FROM documents WHERE {_LOWER.format('text')} LIKE '%the%of%'")
def search_like_ascii(spark, d):
    return table(spark, d, "documents").where(X.like_ascii(F.col("text"), "The%OF")).select("doc_id")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus, c_name, c_mktsegment)), 'high o customer#00000001')")
def search_haystack(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus", "c_name", "c_mktsegment")), F.lit("high o customer#00000001"))).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31' ORDER BY o_orderdate DESC, o_custkey, o_orderkey LIMIT 1000")
def window_between(spark, d):
    rows = table(spark, d, "orders").where("o_orderdate BETWEEN TIMESTAMP_NTZ '1997-03-01' AND TIMESTAMP_NTZ '1997-03-31'")
    return folds.newest(rows, 1000, F.desc("o_orderdate"), F.col("o_custkey"), F.col("o_orderkey")).select("o_orderkey", "o_custkey")


@query("SELECT source, bool_or(l.doc_id IS NULL) AS has_missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def has_missing(spark, d):
    known = table(spark, d, "labels").select("doc_id", F.lit(True).alias("known"))
    return table(spark, d, "documents").select("doc_id", "source").join(known, "doc_id", "left").groupBy("source").agg(F.some(F.col("known").isNull()).alias("has_missing"))


@query("SELECT count(*) AS n_all, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (value > 50) AS n_high FROM events")
def counts_conditional(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n_all"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS n_all FROM events GROUP BY 1")
def jobs_by_state(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("n_all"))))  # one row


@query("SELECT c_custkey AS source, coalesce(n_items, 0) AS n_items, coalesce(n_open, 0) AS n_pending, coalesce(errors, '') AS check_errors, CASE WHEN coalesce(errors, '') LIKE '%error%' THEN 'error' WHEN last IS NULL THEN 'never_synced' WHEN coalesce(n_open, 0) > 0 THEN 'degraded' WHEN (epoch(TIMESTAMP '2000-01-01') - epoch(last)) / 3600 > 26 THEN 'stale' ELSE 'healthy' END AS health FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_items, max(o_orderdate) AS last FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) p ON p.o_custkey = c_custkey LEFT JOIN (SELECT user_id, string_agg(event_type || ': ' || event_id, '; ' ORDER BY event_id) AS errors FROM events WHERE event_type IN ('error', 'signup') AND value > 80 GROUP BY 1) e ON e.user_id = c_custkey")
def source_status_rollup(spark, d):
    """Every source with its counts, open work, check errors and health; the sides are aggregated before they are joined."""
    orders, events = table(spark, d, "orders"), table(spark, d, "events")
    items = orders.groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("n_items"), F.max("o_orderdate").alias("last_success"), F.nullif(F.count_if(F.col("o_orderstatus") == "O"), F.lit(0)).alias("n_pending"))
    bad = events.where(F.col("event_type").isin("error", "signup") & (F.col("value") > 80))
    errors = bad.groupBy(F.col("user_id").alias("source")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat(x["event_type"], F.lit(": "), x["event_id"].cast("string"))), "; ").alias("check_errors"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("source")).join(items, "source", "left").join(errors, "source", "left")
    rows = rows.withColumns({"check_errors": F.coalesce("check_errors", F.lit("")), "last_success": _ts("last_success")})
    rows = rows.withColumn("last_error", F.when(F.contains("check_errors", F.lit("error")), F.lit("error")).otherwise(""))
    shown = rows.withColumn("checks", F.col("check_errors")).withColumn("check_errors", F.lit(""))
    return shown.select("source", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_pending", F.lit(0)).alias("n_pending"), F.col("checks").alias("check_errors"), state.health(shown, F.lit("2000-01-01").cast("timestamp")).alias("health"))


# --- usage ---------------------------------------------------------------------------------

_ATTEMPTS = """(SELECT event_id AS id, ts AS started, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS reservation_active, CASE WHEN event_type = 'signup' THEN event_id % 500 ELSE 0 END AS reserved_total, CASE WHEN event_type = 'signup' THEN event_id % 90 ELSE 0 END AS reserved_cost, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 700 END AS actual_input, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 300 END AS actual_cached, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 50 END AS actual_cache_write, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 400 END AS actual_output, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 100 END AS actual_reasoning, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 700 + event_id % 400 END AS actual_total, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 130 END AS actual_cost FROM events)"""
_LA = "CAST(timezone('America/Los_Angeles', timezone('UTC', {})) AS DATE)"


def _attempts(spark, d):
    return attempts_of(table(spark, d, "events"))


def attempts_of(e: DataFrame) -> DataFrame:
    used = F.col("event_type").isin("click", "purchase")
    held = F.col("event_type") == "signup"
    n = lambda k: F.when(used, F.col("event_id") % k)
    return e.select(F.col("event_id").alias("id"), _ts("ts").alias("started"), held.cast("int").alias("reservation_active"), F.when(held, F.col("event_id") % 500).otherwise(0).alias("reserved_total"), F.when(held, F.col("event_id") % 90).otherwise(0).alias("reserved_cost"), n(700).alias("actual_input"), n(300).alias("actual_cached"), n(50).alias("actual_cache_write"), n(400).alias("actual_output"), n(100).alias("actual_reasoning"), (n(700) + n(400)).alias("actual_total"), n(130).alias("actual_cost"))


def _ledger(spark, d):
    """Carried days: every other civil day, counted up to 15:00 UTC of its own day."""
    a = _attempts(spark, d).withColumn("day", V.civil_day(F.col("started"))).where(F.dayofmonth("day") % 2 == 0)
    a = a.withColumn("covered_through", F.timestamp_seconds(F.unix_timestamp(V.day_bounds(F.col("day"))[0]) + 50400)).where(F.col("started") <= F.col("covered_through"))
    return a.groupBy("day", "covered_through").agg(F.count("*").alias("requests"), F.sum(F.coalesce("actual_total", F.lit(0))).alias("tokens"), F.sum(F.coalesce("actual_cost", F.lit(0))).alias("cost_micros"))


_DAY_START = "timezone('UTC', timezone('America/Los_Angeles', CAST({} AS TIMESTAMP)))"
_LEDGER = f"""(SELECT day, covered AS covered_through, count(*) AS requests, sum(coalesce(actual_total, 0)) AS tokens, sum(coalesce(actual_cost, 0)) AS cost_micros FROM (SELECT *, {_DAY_START.format('day')} + INTERVAL 50400 SECOND AS covered FROM (SELECT *, {_LA.format('started')} AS day FROM {_ATTEMPTS} t0) t1 WHERE day(day) % 2 = 0) t2 WHERE started <= covered GROUP BY 1, 2)"""


@query(f"""WITH a AS (SELECT *, {_LA.format('started')} AS day FROM {_ATTEMPTS} t), l AS (SELECT * FROM {_LEDGER} t),
own AS (SELECT count(*) AS r, sum(CASE WHEN reservation_active = 1 THEN reserved_total ELSE coalesce(actual_total, 0) END) AS t, sum(CASE WHEN reservation_active = 1 THEN reserved_cost ELSE coalesce(actual_cost, 0) END) AS c FROM a WHERE started >= TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM l WHERE l.day = a.day AND a.started <= l.covered_through)),
car AS (SELECT sum(requests) AS r, sum(tokens) AS t, sum(cost_micros) AS c FROM l WHERE {_DAY_START.format('day + 1')} > TIMESTAMP '2024-01-10')
SELECT CAST(own.r + car.r AS BIGINT) AS requests, CAST(own.t + car.t AS BIGINT) AS tokens, CAST(own.c + car.c AS BIGINT) AS cost_micros FROM own, car""")
def usage_totals_since(spark, d):
    return usage.totals_since(_attempts(spark, d), _ledger(spark, d), F.lit("2024-01-10").cast("timestamp"))


_DAILY = f"""SELECT strftime({_LA.format('started')}, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (reservation_active = 0 AND actual_total IS NOT NULL) AS confirmed, count(*) FILTER (reservation_active = 1 OR actual_total IS NULL) AS unconfirmed, CAST(sum(reserved_total) AS BIGINT) AS reserved_tokens, CAST(sum(reserved_cost) AS BIGINT) AS reserved_cost, {', '.join(f'CAST(coalesce(sum(actual_{c}), 0) AS BIGINT) AS "{c}"' for c in ('input', 'cached', 'cache_write', 'output', 'reasoning', 'total', 'cost'))}, CAST(coalesce(sum(greatest(0, actual_input - actual_cached - actual_cache_write)), 0) AS BIGINT) AS cache_miss FROM {_ATTEMPTS} t GROUP BY 1"""


@query(_DAILY)
def usage_daily_la(spark, d):
    return usage.daily_rollup(_attempts(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT * FROM ({_DAILY}) t WHERE day > (SELECT strftime(max({_LA.format('started')}) - 7, '%Y-%m-%d') FROM {_ATTEMPTS} t)")
def usage_retention(spark, d):
    return usage.daily_rollup(_attempts(spark, d), keep_days=7).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT strftime(day, '%Y-%m-%d') AS day, rule FROM (SELECT day, CASE WHEN confirmed + unconfirmed <> requests THEN 'requests' WHEN cached + cache_miss + cache_write <> input THEN 'input' WHEN reasoning > output THEN 'reasoning' WHEN total < input + output THEN 'total' WHEN reserved_tokens > 0 AND unconfirmed = 0 THEN 'reserved' END AS rule FROM (SELECT CAST(day AS DATE) AS day, * EXCLUDE (day) FROM ({_DAILY}) t0) t) t2 WHERE rule IS NOT NULL")
def ledger_algebra_violations(spark, d):
    return usage.ledger_violations(usage.daily_rollup(_attempts(spark, d))).select(F.col("day").cast("string").alias("day"), "rule")


@query("SELECT user_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS started FROM (SELECT *, lag(ts + INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts) AS previous_end FROM events) t WHERE ts < previous_end")
def ledger_overlap_check(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("end"))
    return joins.overlaps(e, "ts", "end", ["user_id"]).select("user_id", "event_id", _text("ts").alias("started"))


@query(f"""WITH u AS (SELECT {_LA.format('started')} AS day, CAST(sum(coalesce(actual_total, 0)) AS BIGINT) AS tokens FROM {_ATTEMPTS} t GROUP BY 1), m AS (SELECT date_trunc('month', day) AS month, sum(tokens) AS used FROM u GROUP BY 1),
r AS (SELECT event_id AS id, ts, event_id % 60000 AS tokens, {_LA.format('ts')} AS day FROM events WHERE event_type = 'purchase'),
j AS (SELECT r.*, coalesce(u.tokens, 0) + r.tokens > 90000 AS over_day, coalesce(m.used, 0) + r.tokens > 2000000 AS over_month FROM r LEFT JOIN u ON u.day = r.day LEFT JOIN m ON m.month = date_trunc('month', r.day))
SELECT id, CASE WHEN tokens > 50000 AND tokens > 90000 THEN 'impossible' WHEN over_day OR over_month THEN 'blocked' ELSE 'allowed' END AS decision, CASE WHEN NOT tokens > 90000 AND (over_day OR over_month) THEN strftime(greatest(CASE WHEN over_day THEN {_DAY_START.format('day + 1')} END, CASE WHEN over_month THEN {_DAY_START.format("date_trunc('month', day) + INTERVAL 1 MONTH")} END), '%Y-%m-%dT%H:%M:%SZ') END AS next_reset FROM j""")
def budget_decision(spark, d):
    used = _attempts(spark, d).groupBy(V.civil_day(F.col("started")).alias("day")).agg(F.sum(F.coalesce("actual_total", F.lit(0))).alias("tokens"))
    requests = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), _ts("ts").alias("ts"), (F.col("event_id") % 60000).alias("tokens"))
    return usage.budget_decisions(requests, used, 90000, 2000000).select("id", "decision", V.utc_text(F.col("next_reset")).alias("next_reset"))


# --- keys and folds ------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1")
def latest_per_key(spark, d):
    return folds.latest_by(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT l.doc_id, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id AND (d.n_chars % 2) = l.quality")
def latest_fresh_artifact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return table(spark, d, "labels").join(docs, ["doc_id", "quality"]).select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY doc_id LIMIT 200")
def coverage_missing(spark, d):
    have = table(spark, d, "labels").where("quality = 1")
    return folds.newest(joins.difference(table(spark, d, "documents").select("doc_id"), have.select("doc_id"), "doc_id"), 200, F.col("doc_id"))


@query("SELECT o_custkey, o_orderkey, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) AS rank FROM orders) t WHERE rank <= 3")
def history_topn_per_source(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("published"))
    return folds.top_n_per_key(rows, ["o_custkey"], 3, F.desc_nulls_last("published"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT host, page_id, CAST(priority AS BIGINT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority, page_id) AS n FROM (SELECT {_HOST} AS host, page_id, 0 AS priority FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT {_HOST} AS host, page_id, 1 AS priority FROM pages) t) t2 WHERE n = 1")
def priority_dedup(spark, d):
    pages = table(spark, d, "pages").select(U.host_key(F.col("url")).alias("host"), "page_id")
    return folds.priority_dedup([pages.where("page_id % 3 = 0"), pages], "host", "page_id").select("host", "page_id", F.col("priority").cast("long").alias("priority"))


_SEP = "chr(31)"


@query(f"""WITH p AS (SELECT {_HOST} AS host, page_id AS pos, url AS title, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'a' || page_id END AS author FROM pages),
f AS (SELECT host, min(pos) AS pos, arg_max(title, length(title) * 1000000 - pos) AS title, coalesce(arg_min(author, pos) FILTER (author <> ''), '') AS author FROM p GROUP BY 1)
SELECT host, pos, title, author, sha256(concat_ws({_SEP}, host, title, author)) AS content_hash FROM f""")
def fold_merge_url(spark, d):
    pages = table(spark, d, "pages").select(U.host_key(F.col("url")).alias("host"), F.col("page_id").alias("pos"), F.col("url").alias("title"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("a"), F.col("page_id").cast("string"))).alias("author"))
    out = folds.fold_merge(pages, "host", "pos", ["title"], ["author"])
    return out.withColumn("content_hash", V.stable_hash(F.col("host"), F.col("title"), F.col("author")))


@query("SELECT doc_id, used FROM (SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) t WHERE used <= 20000")
def greedy_budget_prefix(spark, d):
    return folds.budget_prefix(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.col("doc_id")], F.col("n_chars"), 20000).select("doc_id", "used")


@query()
def greedy_packet_exact(spark, d):
    return publish.packets(table(spark, d, "documents"), "source", "doc_id", F.col("lang"), F.col("text"), 6000)


# --- URLs and text ---------------------------------------------------------------------------


@query(f"SELECT page_id, canonical AS url FROM {_PAGES}")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_url_sql(F.col("url")).alias("url"))


@query(f"SELECT page_id, canonical AS url FROM {_PAGES}")
def canonical_url_general(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))


@query(f"SELECT {_HOST} AS host, count(*) AS n_pages FROM pages GROUP BY 1")
def url_host_counts(spark, d):
    return table(spark, d, "pages").groupBy(U.host_key(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"))


@query(r"SELECT page_id FROM pages WHERE regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '^/+en/+[^/]+/*$') AND NOT regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/(tag|topic)/*$')")
def url_shape_filter(spark, d):
    return table(spark, d, "pages").where(U.one_slug_below(F.col("url"), "en", ("tag", "topic"))).select("page_id")


@query(r"SELECT page_id FROM pages WHERE regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '^/+fr(/|$)')")
def url_prefix_filter(spark, d):
    return table(spark, d, "pages").where(U.under_prefix(F.col("url"), "/fr")).select("page_id")


@query(f"SELECT doc_id, sha256({_CLEAN}) AS clean_hash, length({_CLEAN}) AS n FROM documents")
def text_clean_sql(spark, d):
    clean = X.output_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(clean, 256).alias("clean_hash"), F.length(clean).cast("long").alias("n"))


@query()
def clean_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_text(800, True)(F.col("html")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN rtrim(substring(text, 1, 499), ' ') || '…' ELSE text END AS title FROM documents")
def field_caps(spark, d):
    return table(spark, d, "documents").select("doc_id", X.capped(F.col("text"), 500).alias("title"))


@query(f"SELECT doc_id, sha256(concat_ws({_SEP}, coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''))) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", V.stable_hash(F.col("text"), F.col("lang"), F.col("source")).alias("content_hash"))


@query("SELECT doc_id FROM documents WHERE length(text) <> n_chars OR sha256(text) < '08'")
def hash_mismatch(spark, d):
    return table(spark, d, "documents").where((F.length("text") != F.col("n_chars")) | (F.sha2("text", 256) < "08")).select("doc_id")


@query("SELECT doc_id, strlen(concat_ws(chr(10), coalesce(text, ''), coalesce(lang, ''))) + 2048 AS bound, (strlen(text) + 3) // 4 AS approximate FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", V.token_estimate(F.col("text"), F.col("lang")).alias("bound"), V.approximate_tokens(F.col("text")).alias("approximate"))


@query("SELECT l_orderkey, l_linenumber, CAST(ceil(CAST(l_quantity AS BIGINT) * 250 * 0.25 + l_linenumber * 100 * 1.5) AS BIGINT) AS cost_micros FROM lineitem")
def cost_micros(spark, d):
    q = F.col("l_quantity").cast("long") * 250
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.cost_micros(q, F.col("l_linenumber") * 100, 0.25, 1.5).alias("cost_micros"))


@query("SELECT doc_id, length(trim(text)) > 10 AS untranslated FROM documents")
def cjk_untranslated(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.seems_untranslated(F.lit("source"), t, F.lit("zh-CN")).alias("untranslated"))


@query(r"SELECT doc_id, regexp_replace(text, '([!-/:-@\[-`{-~])', '\\\1', 'g') AS escaped FROM documents")
def markdown_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", X.markdown_escape(F.col("text")).alias("escaped"))


@query(r"SELECT o_orderkey, '- [' || regexp_replace(o_orderpriority, '([!-/:-@\[-`{-~])', '\\\1', 'g') || '](https://example.org/' || o_orderkey || ') — ' || regexp_replace(c_name, '([!-/:-@\[-`{-~])', '\\\1', 'g') || ' · ' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def digest_lines(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    url = F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string"))
    return folds.newest(rows, 100, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", publish.digest_line(F.col("o_orderpriority"), F.col("c_name"), _text("o_orderdate"), url).alias("line"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS pub_date FROM orders")
def rss_pubdate(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.rfc822(_ts("o_orderdate")).alias("pub_date"))


@query()
def snapshot_json(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    rows = joins.with_children(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", _text("o_orderdate").alias("published")), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], ["l_linenumber"], "items")
    return rows.select("o_orderkey", F.size("items").cast("long").alias("n_items"), publish.snapshot_row("o_orderkey", "o_orderstatus", "published", "items").alias("json"))


@query()
def rss_items(spark, d):
    pages = table(spark, d, "pages").select("page_id", html.extract_main("html").alias("m"), U.canonical_url_sql(F.col("url")).alias("url"))
    return pages.select("page_id", publish.rss_item(F.col("m.title"), F.col("url"), X.capped(F.col("m.text"), 800), F.timestamp_seconds(F.col("page_id") * 86400)).alias("item"))


# --- pages, feeds ------------------------------------------------------------------------------


@query()
def extract_main(spark, d):
    return table(spark, d, "pages").select("page_id", html.extract_main("html").alias("m")).select("page_id", "m.*")


@query()
def truncate_boundary(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_content(500)(F.col("text")).alias("t")).select("doc_id", "t.*")


@query()
def parse_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(html.page_links("html", "url"))).select("page_id", "pos", "col.url", "col.text")


@query()
def parse_cards(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(html.page_cards("html", "url"))).select("page_id", "pos", "col.*")


@query(r"SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language FROM pages")
def page_language(spark, d):
    return table(spark, d, "pages").select("page_id", html.page_metadata("html", "url")["language"].alias("language"))


@query()
def page_metadata(spark, d):
    return table(spark, d, "pages").select("page_id", html.page_metadata("html", "url").alias("m")).select("page_id", "m.*")


@query(f"SELECT page_id, canonical AS url, 'Page ' || page_id AS title FROM {_PAGES}")
def parse_feed_rows(spark, d):
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<rss><channel><item><title>Page "), F.col("page_id").cast("string"), F.lit("</title><link>"), url, F.lit("</link></item></channel></rss>"))
    return table(spark, d, "pages").select("page_id", F.explode(feeds.feed_rows(xml)).alias("i")).select("page_id", "i.url", "i.title")


@query(f"SELECT page_id, canonical AS url, '2024-01-0' || (page_id % 9 + 1) || 'T00:00:00Z' AS modified FROM {_PAGES}")
def parse_sitemap_rows(spark, d):
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<urlset><url><loc>"), url, F.lit("</loc></url><url><loc>"), url, F.lit("</loc><lastmod>2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("</lastmod></url></urlset>"))
    return table(spark, d, "pages").select("page_id", F.explode(feeds.sitemap_rows(xml)).alias("i")).select("page_id", "i.url", "i.modified")


@query(f"SELECT page_id, CAST(1 AS INTEGER) AS pos, 'Page ' || page_id AS title, canonical AS url, 'about it' AS summary FROM {_PAGES}")
def parse_markdown_rows(spark, d):
    text = F.concat(F.lit("# Index\n- [Page "), F.col("page_id").cast("string"), F.lit("]("), F.regexp_replace("url", r"^([^?#]*)", "$1.md"), F.lit("): about it\n* [no](https://x.org/bullet.md)\n- [no](https://x.org/page)"))
    return feeds.markdown_index(table(spark, d, "pages"), text, ["page_id"])


# --- state -------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, event_type, max(CASE WHEN value > 20 THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE '' END) AS modified FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1, 2),
e AS (SELECT user_id, event_type, max(CASE WHEN value > 20 THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE '' END) AS modified FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1, 2)
SELECT e.user_id, e.event_type, CASE WHEN e.user_id NOT IN (SELECT user_id FROM s) THEN 'baseline' WHEN s.user_id IS NULL THEN 'new' WHEN s.modified <> '' AND e.modified <> '' AND s.modified <> e.modified THEN 'modified' ELSE 'same' END AS change FROM e LEFT JOIN s USING (user_id, event_type)""")
def seen_diff(spark, d):
    """Users are sources: what the first two days of events have shown of them against all later ones."""
    # a cast to an integer cuts here and rounds half to even in the twin
    e = table(spark, d, "events").withColumn("modified", F.when(F.col("value") > 20, F.bround("value").cast("long").cast("string")).otherwise(""))
    fold = lambda x: x.groupBy("user_id", "event_type").agg(F.max("modified").alias("modified"))
    early = F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")
    return joins.seen_diff(fold(e.where(~early)), fold(e.where(early)), ["user_id", "event_type"], "modified").select("user_id", "event_type", "change")


def _merged(spark, d):
    """A store with the first filled order of each key of a source, but for sources that begin now, and all other orders as the batch."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("source"), (F.col("o_orderkey") % 40).cast("string").alias("ext"), F.floor(F.col("o_orderkey") / 3).cast("string").alias("url"), F.col("o_orderpriority").alias("title"), "o_orderstatus")
    first = rows.where("o_orderstatus = 'F' AND source < 40").groupBy("source", "ext").agg(F.min("id").alias("id"))
    first = first.join(rows.drop("ext"), ["source", "id"]).groupBy("source", "url").agg(F.min("id").alias("id"))
    stored = rows.join(first.select("id"), "id", "left_semi").drop("o_orderstatus").withColumn("seen", F.lit(False))
    batch = rows.join(first.select("id"), "id", "left_anti").drop("o_orderstatus").withColumnRenamed("id", "pos")
    return state.merge_by_either_key(stored, batch, "source", "ext", "url", ["title"], "pos")


_MERGE = """WITH r AS (SELECT o_orderkey AS id, o_custkey % 50 AS source, CAST(o_orderkey % 40 AS VARCHAR) AS ext, CAST(o_orderkey // 3 AS VARCHAR) AS url, o_orderpriority AS title, o_orderstatus AS st FROM orders),
f AS (SELECT * FROM r WHERE st = 'F' AND source < 40 QUALIFY row_number() OVER (PARTITION BY source, ext ORDER BY id) = 1), s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY id) = 1),
b1 AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM s) QUALIFY row_number() OVER (PARTITION BY source, ext ORDER BY id DESC) = 1), b AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY id DESC) = 1),
m AS (SELECT b.*, (SELECT min(s.id) FROM s WHERE s.source = b.source AND (s.ext = b.ext OR s.url = b.url)) AS own FROM b), hit AS (SELECT * FROM m WHERE own IS NOT NULL QUALIFY row_number() OVER (PARTITION BY own ORDER BY id DESC) = 1),
x AS (SELECT s.id, s.source, CASE WHEN d THEN hit.ext ELSE s.ext END AS ext, CASE WHEN d THEN hit.url ELSE s.url END AS url, CASE WHEN d THEN hit.title ELSE s.title END AS title, false AS seen, CASE WHEN d THEN 'updated' ELSE 'kept' END AS change FROM (SELECT s.id AS sid, hit.own IS NOT NULL AND (hit.ext <> s.ext OR hit.url <> s.url OR hit.title <> s.title) AS d FROM s LEFT JOIN hit ON hit.own = s.id) z JOIN s ON s.id = sid LEFT JOIN hit ON hit.own = s.id
  UNION ALL SELECT NULL, source, ext, url, title, source NOT IN (SELECT source FROM s), CASE WHEN source IN (SELECT source FROM s) THEN 'inserted' ELSE 'baseline' END FROM m WHERE own IS NULL)
"""


@query(_MERGE + "SELECT * FROM x")
def merge_upsert(spark, d):
    """The merged store; the numbers of new rows are any that follow, so they are not shown."""
    out = _merged(spark, d)
    return out.select(F.when(F.col("change").isin("kept", "updated"), F.col("id")).alias("id"), "source", "ext", "url", "title", "seen", "change")


@query(_MERGE + "SELECT source, count(*) FILTER (change = 'inserted') AS n_inserted, count(*) FILTER (change = 'updated') AS n_updated, count(*) FILTER (change = 'baseline') AS n_baseline, count(*) FILTER (change = 'kept') AS n_kept FROM x GROUP BY 1")
def merge_counters(spark, d):
    return state.merge_counts(_merged(spark, d), "source")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END DESC, event_id DESC) AS n FROM events) t WHERE n = 1")
def import_last_writer_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return state.last_writer_wins(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "ts").select("user_id", "event_id", "event_type")


@query("""WITH p AS (SELECT user_id AS id, count(*) AS attempts, min(ts) AS first_seen, max(ts) AS failed, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'modified' END AS change FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT id, change, attempts, strftime(failed + to_seconds(CAST(least(21600, 60 * power(2, least(attempts - 1, 8))) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS next_attempt FROM p WHERE date_trunc('second', failed) + to_seconds(CAST(least(21600, 60 * power(2, least(attempts - 1, 8))) AS BIGINT)) <= TIMESTAMP '2024-01-29' ORDER BY CASE WHEN change = 'new' THEN 0 ELSE 1 END, first_seen, id LIMIT 200""")
def pending_due_queue(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    p = e.groupBy(F.col("user_id").alias("id")).agg((F.count("*") - 1).alias("attempts"), F.min("ts").alias("first_seen"), F.max("ts").alias("failed_at"))
    p = p.withColumns({"url": F.col("id"), "change": F.when(F.col("id") % 2 == 0, "new").otherwise("modified"), "last_error": F.lit(""), "next_attempt": F.lit(None).cast("timestamp"), "failed_at": _ts("failed_at")})
    failures = p.select("id", F.lit("down").alias("error"), "failed_at", F.lit(None).cast("int").alias("retry_after"))
    after = state.record_failures(p.drop("failed_at"), failures, ["id"])
    return state.due(after, F.lit("2024-01-29").cast("timestamp"), 200).select("id", "change", "attempts", V.utc_text(F.col("next_attempt")).alias("next_attempt"))


@query("SELECT event_id AS id FROM events WHERE event_type IN ('click', 'view') AND user_id % 5 < 3 AND ts <= TIMESTAMP '2024-01-20' ORDER BY user_id % 3, ts, event_id LIMIT 25")
def queue_head(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "retry").otherwise("done").alias("state"), (F.col("user_id") % 5).alias("attempts"), F.lit(3).alias("max_attempts"), _ts("ts").alias("due"), (F.col("user_id") % 3).alias("priority"), F.col("ts").alias("created"))
    return state.queue_head(e, F.lit("2024-01-20").cast("timestamp"), 25).select("id")


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 900 SECOND AND user_id % 2 = 0 THEN 'failed' WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 900 SECOND THEN 'queued' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS state FROM events")
def stalled_recovery(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), _ts("ts").alias("updated"), (F.col("user_id") % 2 == 0).alias("sent"))
    return state.recover_stalled(e, F.lit("2024-01-15").cast("timestamp")).select("id", "state")


_CLASS = "CASE event_type WHEN 'error' THEN 'ambiguous' WHEN 'purchase' THEN 'paid_failure' ELSE 'fallback_pending' END"


@query(f"SELECT user_id, hold_class, id FROM (SELECT user_id, {_CLASS} AS hold_class, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, event_id) AS n FROM events) t WHERE n = 1")
def risk_max_class(spark, d):
    c = F.when(F.col("event_type") == "error", "ambiguous").when(F.col("event_type") == "purchase", "paid_failure").otherwise("fallback_pending")
    return state.highest_risk(table(spark, d, "events").select("user_id", c.alias("hold_class"), F.col("event_id").alias("id")), "user_id")


@query("SELECT k, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, sha256(event_type || chr(31) || json_extract_string(props, '$.k')) AS k FROM events) t GROUP BY 1 HAVING count(*) > 1")
def semantic_group(spark, d):
    key = V.stable_hash(F.col("event_type"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).where("n > 1")


@query("SELECT event_id, event_type FROM events WHERE NOT (ts < TIMESTAMP '2024-01-20')")
def purge_before(spark, d):
    return state.purge(table(spark, d, "events"), "ts", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "event_type")


@query("SELECT o_orderkey, count(*) FILTER (l_quantity > 25) AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def public_projection(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    rows = joins.with_children(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey", ["l_quantity"], ["l_linenumber"], "items")
    return publish.public_projection(rows, ["o_totalprice"], "items", lambda x: x["l_quantity"] > 25).select("o_orderkey", "n_items")


# --- constraints ---------------------------------------------------------------------------------


@query("SELECT h, n_rows FROM (SELECT sha256(text) AS h, count(*) AS n_rows FROM documents GROUP BY 1) t WHERE n_rows > 1")
def uniqueness_violations(spark, d):
    return joins.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), ["h"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def referential_violations(spark, d):
    return joins.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, d, "orders").where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey")


@query("SELECT lang, count(*) FILTER (l.doc_id IS NULL) AS remaining FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def set_diff_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    left = joins.difference(docs, table(spark, d, "labels").select("doc_id"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))
    return docs.select("lang").distinct().join(left, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("remaining"))


@query("SELECT source, count(*) AS n_rows, count(*) < greatest(3, 60 // 5) AS drifted FROM documents GROUP BY 1")
def parser_drift(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_rows")).withColumn("drifted", F.col("n_rows") < F.greatest(F.lit(3), F.floor(F.lit(60) / 5)))


# --- decisions -----------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN s IN (408, 409, 425) OR s >= 500 THEN 'ambiguous' WHEN s IN (401, 402, 404, 429) OR event_type = 'signup' THEN 'fallback' ELSE 'final' END AS failure FROM (SELECT *, 400 + event_id % 120 AS s FROM events) t")
def failure_classes(spark, d):
    code = F.when(F.col("event_type") == "signup", "no_output").otherwise("other")
    return table(spark, d, "events").select("event_id", decisions.failure_class(400 + F.col("event_id") % 120, code).alias("failure"))


@query(f"WITH h AS (SELECT user_id, bool_or(c = 'ambiguous') AS a, bool_or(c = 'paid_failure') AS p, bool_or(c = 'fallback_pending') AS f FROM (SELECT user_id, {_CLASS} AS c FROM events) t GROUP BY 1) SELECT u.user_id, CASE WHEN coalesce(a, false) AND u.user_id % 7 <> 0 THEN 'held_ambiguous' WHEN coalesce(p, false) AND u.user_id % 3 <> 0 AND u.user_id % 7 <> 0 THEN 'held_paid' WHEN coalesce(f, false) THEN 'continue' ELSE 'send' END AS decision FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN h USING (user_id)")
def hold_admission(spark, d):
    e = table(spark, d, "events")
    c = F.when(F.col("event_type") == "error", "ambiguous").when(F.col("event_type") == "purchase", "paid_failure").otherwise("fallback_pending")
    requests = e.select("user_id").distinct().withColumns({"retry_paid": F.col("user_id") % 3 == 0, "force": F.col("user_id") % 7 == 0})
    return decisions.admission(requests, e.select("user_id", c.alias("hold_class")), "user_id").select("user_id", "decision")


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'sent' WHEN event_type = 'purchase' THEN 'succeeded' WHEN 400 + event_id % 120 IN (408, 409, 425) OR 400 + event_id % 120 >= 500 THEN 'ambiguous' WHEN 400 + event_id % 120 IN (401, 402, 404, 429) AND event_id % 5 < 3 THEN 'retry' ELSE 'failed' END AS state, CASE WHEN event_type = 'view' THEN 1 WHEN event_type <> 'purchase' AND (400 + event_id % 120 IN (408, 409, 425) OR 400 + event_id % 120 >= 500) AND event_id % 2 = 0 THEN 1 ELSE 0 END AS reservation_active FROM events")
def attempt_settlement(spark, d):
    e = table(spark, d, "events")
    attempts = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("attempt"), F.lit("sent").alias("state"), F.lit(1).alias("reservation_active"), F.lit(None).cast("long").alias("actual_total"))
    outcomes = e.where("event_type <> 'view'").select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("ok"), (400 + F.col("event_id") % 120).alias("status"), F.lit("other").alias("code"), F.when(F.col("event_id") % 2 == 1, F.col("event_id")).alias("used"))
    return decisions.settle(attempts, outcomes).select("id", "state", "reservation_active")


@query("SELECT event_id, event_id % 50 AS input, event_id % 30 AS output, greatest(event_id % 50 + event_id % 30, CASE WHEN event_id % 2 = 1 THEN 3 ELSE 0 END) AS total FROM events")
def reported_usage(spark, d):
    body = F.when(F.col("event_id") % 2 == 0, F.format_string('{"input_tokens":%d,"output_tokens":%d}', F.col("event_id") % 50, F.col("event_id") % 30)).otherwise(F.format_string('{"prompt_tokens":%d,"completion_tokens":%d,"total_tokens":3}', F.col("event_id") % 50, F.col("event_id") % 30))
    u = table(spark, d, "events").where("event_id % 50 + event_id % 30 >= 0").select("event_id", decisions.reported_usage(body).alias("u"))
    return u.select("event_id", "u.input", "u.output", "u.total")


@query("SELECT user_id, count(*) FILTER (event_type = 'error' AND event_id > last_ok) AS failures FROM (SELECT *, coalesce(max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id), -1) AS last_ok FROM events) t GROUP BY 1")
def check_streaks(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return state.check_streaks(e, ["user_id"], "event_id", "ok")


@query("SELECT d.doc_id, d.source, coalesce(m.top, 0) + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS revision FROM documents d LEFT JOIN (SELECT source, max(n_chars) AS top FROM documents WHERE doc_id % 4 = 0 GROUP BY 1) m USING (source) WHERE d.doc_id % 4 <> 0")
def reserve_revisions(spark, d):
    docs = table(spark, d, "documents")
    have = docs.where("doc_id % 4 = 0").select("source", F.col("n_chars").alias("revision"))
    return state.next_numbers(docs.where("doc_id % 4 <> 0").select("doc_id", "source"), have, "revision", "source", ["doc_id"]).select("doc_id", "source", "revision")


@query()
def fit_payloads(spark, d):
    return table(spark, d, "documents").select("doc_id", decisions.fit_payload(F.col("text"), 600, lang=F.col("lang")).alias("payload"))


from . import digests as _digests  # noqa: E402, F401  registers its queries
from . import exchange as _exchange  # noqa: E402, F401  registers its queries
from . import extensions as _extensions  # noqa: E402, F401  registers its queries
from . import fetches as _fetches  # noqa: E402, F401  registers its queries
from . import further as _further  # noqa: E402, F401  registers its queries
from . import more as _more  # noqa: E402, F401  registers its queries
from . import ordered as _ordered  # noqa: E402, F401  registers its queries
from . import streams as _streams  # noqa: E402, F401  registers its queries
from . import tables as _tables  # noqa: E402, F401  registers its queries
