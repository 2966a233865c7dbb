"""Registered queries of listings, the exchange of outputs, holds and publication, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import artifacts as A
from ..operators import cache
from ..session import table
from ..sources import listings
from .registry import query

LIMITS = {"page": 500, "json": 500, "feed": 100}
_PLACES = "t AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders), u AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders WHERE o_orderstatus = 'O'), p AS (SELECT 'page' AS outlet, position, o_orderkey FROM t WHERE position <= 500 UNION ALL SELECT 'json', position, o_orderkey FROM t WHERE position <= 500 UNION ALL SELECT 'feed', position, o_orderkey FROM t WHERE position <= 100 UNION ALL SELECT 'digest', position, o_orderkey FROM u WHERE position <= 100)"


def _outlets(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return cache.outlets(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderstatus") == "O", LIMITS, 100).select("outlet", "position", "o_orderkey")


@query(f"WITH {_PLACES} SELECT * FROM p")
def publication_outlets(spark, d):
    return _outlets(spark, d)


@query(f"WITH {_PLACES}, n AS (SELECT outlet, count(*) AS returned_count FROM p GROUP BY 1) SELECT outlet, returned_count, CAST(CASE WHEN outlet IN ('page', 'json') THEN 500 ELSE 100 END AS BIGINT) AS \"limit\", CAST(greatest((SELECT count(*) FROM orders) - returned_count, 0) AS BIGINT) AS omitted_count, (SELECT count(*) FROM orders) > returned_count AS truncated FROM n")
def publication_counts(spark, d):
    return cache.page_counts(_outlets(spark, d), table(spark, d, "orders").agg(F.count("*").alias("total")), LIMITS | {"digest": 100})


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS title, CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_acctbal < 0 THEN 's' ELSE c_name END END AS publisher_summary, CASE WHEN c_acctbal < 0 THEN 's' WHEN c_mktsegment = 'MACHINERY' THEN c_name END AS summary, CASE WHEN c_acctbal < 0 THEN 2 ELSE 0 END AS points FROM customer")
def artifact_payloads(spark, d):
    s = F.col("c_mktsegment")
    task = F.when(s == "BUILDING", "translation").when(s == "MACHINERY", "summary").otherwise("other")
    output = F.when(F.col("c_acctbal") < 0, F.concat(F.lit('{"title":" '), F.col("c_name"), F.lit(' ","summary":"s","key_points":["a","  ","b"]}'))).otherwise("old")
    c = table(spark, d, "customer").withColumn("p", A.payload(task, s, F.col("c_name"), output))
    return c.select("c_custkey", "p.title", "p.publisher_summary", "p.summary", F.size("p.key_points").alias("points"))


@query("SELECT c_custkey, c_acctbal >= 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY') AS valid FROM customer")
def valid_translations(spark, d):
    s, minus = F.col("c_mktsegment"), F.col("c_acctbal") < 0
    title = F.when(~minus, F.concat(F.lit("译文："), F.col("c_name"))).when(s == "BUILDING", "short name").when(s == "MACHINERY", None).otherwise(F.col("c_name"))
    body = F.when(minus & (s == "MACHINERY"), F.lit("カタカナだけの長い概要です"))
    fields = F.struct(title.alias("title"), body.alias("publisher_summary"))
    return table(spark, d, "customer").select("c_custkey", A.valid_translation(fields, F.lit("zh-CN")).alias("valid"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN event_id % 3 = 0 WHEN event_type = 'error' THEN event_id % 3 < 2 ELSE event_type <> 'purchase' END AS settled FROM events")
def settled_holds(spark, d):
    t, k = F.col("event_type"), F.col("event_id") % 3
    hold = F.when(t.isin("error", "view"), "ambiguous").when(t == "click", "fallback_pending").when(t == "signup", "paid_failure").otherwise("other")
    task = F.when(k < 2, "translation").otherwise("summary")
    fields = F.when(k == 0, F.array(F.lit("title"), F.lit("publisher_summary"))).otherwise(F.array(F.lit("title")))
    return table(spark, d, "events").select("event_id", A.settled_by_success(hold, task, fields, t == "view").alias("settled"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, bool_or(event_type = 'signup') AND bool_and(event_type IN ('signup', 'click', 'view')) AS retry, NOT bool_or(event_type = 'error') AND (count(*) FILTER (event_type = 'purchase') = 0 OR count(*) FILTER (event_type = 'signup') > 0) AS settle FROM events GROUP BY 1, 2")
def hold_permissions(spark, d):
    """What the holds of each user and day allow; purchases are holds of another class."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "paid_failure").when(t.isin("click", "view"), "fallback_pending").when(t == "error", "ambiguous").otherwise("other")
    g = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set(kind).alias("c"))  # four classes
    exact = F.when(F.array_contains("c", "other"), F.when(F.array_contains("c", "paid_failure"), "paid_failure").otherwise("fallback_pending"))
    return g.select("user_id", "day", A.paid_retry_authorized(F.col("c")).alias("retry"), A.may_settle(exact, F.col("c"), F.lit(True)).alias("settle"))


@query("SELECT o_orderkey, c_custkey AS article_id, CASE WHEN c_custkey IS NULL THEN 'unresolved' WHEN o_orderstatus = 'P' THEN 'untranslated' WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'collision' WHEN o_orderstatus = 'F' THEN 'present' ELSE 'insert' END AS outcome FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey")
def cache_import(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("identity"), "o_orderstatus", "o_orderpriority")
    stored = o.where("o_orderstatus = 'F'").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "other").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    articles = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("identity"), F.col("c_custkey").alias("article_id"), "c_name")
    return cache.import_cache(stored, o, articles, ["identity"], "o_orderkey", ["o_orderpriority"], (F.col("o_orderstatus") == "P") & F.col("c_name").isNotNull()).select("o_orderkey", "article_id", "outcome")


def _exported(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("task"), F.lit("zh-CN").alias("language"), "o_orderdate", "o_orderkey")
    return o, cache.export_cache(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT o_custkey, o_orderpriority AS task, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2")
def cache_export(spark, d):
    return _exported(spark, d)[1].select("o_custkey", "task", "o_orderkey")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) AS artifacts, (SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) AS skipped_duplicates, count(*) AS holds, count(*) FILTER (event_type = 'error') AS ambiguous, count(*) FILTER (event_type = 'signup') AS paid_failure, CAST(0 AS BIGINT) AS fallback_pending FROM events")
def cache_export_counts(spark, d):
    t = F.col("event_type")
    holds = table(spark, d, "events").select(F.when(t == "error", "ambiguous").when(t == "signup", "paid_failure").otherwise(t).alias("hold_class"))
    return cache.export_counts(*_exported(spark, d), holds)


@query("SELECT event_id FROM events JOIN customer ON user_id = c_custkey WHERE event_type = CASE WHEN c_acctbal < 0 THEN 'click' ELSE 'view' END")
def contract_matches(spark, d):
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") < 0, "click").otherwise("view").alias("event_type"))
    return cache.contract_matches(table(spark, d, "events"), now, ["user_id"], ["event_type"]).select("event_id")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 'keys differ from the contract' WHEN 'FURNITURE' THEN 'another language' WHEN 'HOUSEHOLD' THEN 'title is empty' END AS error, CASE c_mktsegment WHEN 'BUILDING' THEN c_name || chr(10) || chr(10) || 'body' WHEN 'AUTOMOBILE' THEN 'all' || chr(10) || '• ' || c_name END AS readable FROM customer")
def checked_outputs(spark, d):
    s, name = F.col("c_mktsegment"), F.col("c_name")
    part = lambda k, v: F.concat(F.lit(f'"{k}":"'), v, F.lit('"'))
    both = lambda title, lang: F.concat(F.lit("{"), F.concat_ws(",", part("title", title), part("publisher_summary", F.lit("body")), part("language", lang), part("limitations", F.lit(""))), F.lit("}"))
    short = F.concat(F.lit('{"summary":" all ","key_points":["'), name, F.lit('"],"language":"zh-CN","basis":"metadata","limitations":""}'))
    zh = F.lit("zh-CN")
    text = F.when(s == "MACHINERY", F.lit('{"title":"x"}')).when(s == "AUTOMOBILE", short).when(s == "FURNITURE", both(name, F.lit("en"))).when(s == "HOUSEHOLD", both(F.lit("  "), zh)).otherwise(both(name, zh))
    c = table(spark, d, "customer").withColumn("r", A.checked_output(F.when(s == "AUTOMOBILE", "summary").otherwise("translation"), text, zh))
    return c.select("c_custkey", "r.error", "r.readable")


# listings of items link to www.x.org, the others to where they are; a link keeps its host
_URL = "'https://' || CASE WHEN page_id % 5 = 1 THEN 'www.' ELSE '' END || 'x.org/' || CASE WHEN page_id % 5 = 2 THEN 'news' ELSE 'blog' END || '/p' || page_id"


@query(f"SELECT page_id, CASE page_id % 5 WHEN 4 THEN 'list_items found no articles' END AS error, CASE WHEN page_id % 5 < 4 THEN {_URL} END AS url, CASE WHEN page_id % 5 < 4 THEN 'Title ' || page_id END AS title, CASE WHEN page_id % 5 < 4 THEN 'About it.' END AS summary, CASE WHEN page_id % 5 < 4 THEN 'Kind' END AS category, CASE WHEN page_id % 5 < 4 THEN '2024-03-05T00:00:00Z' END AS published_at, CASE WHEN page_id % 5 < 4 THEN sha256({_URL} || chr(31) || 'Title ' || page_id || chr(31) || 'About it.' || chr(31) || chr(31) || 'Kind' || chr(31) || '2024-03-05T00:00:00Z' || chr(31)) END AS content_hash FROM pages")
def listing_entries(spark, d):
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    cards = F.concat(F.lit('<a class="resource-item" href="/blog/p'), i, F.lit('?utm_source=a"><img alt="Title '), i, F.lit('"><p>other</p><p class="line-clamp-3">About <b>it</b>.</p><i class="pt-2 text-sm text-secondary">Kind</i><i class="pt-4 text-secondary">Mar 5, 2024</i></a>'))
    items = F.concat(F.lit('<div role="listitem" class="blog_cms_item"><a href="/blog/tag">t</a><a href="https://www.x.org/blog/p'), i, F.lit('" data-cta-copy="Title '), i, F.lit('">Read</a><p class="card_summary">About it.</p><b fs-list-field="category">Kind</b><span>March 5, 2024</span></div>'))
    grid = F.concat(F.lit('<a class="PublicationList-row" href="/news/p'), i, F.lit('"><div class="subtitle">no</div><h3 class="title">Title '), i, F.lit('</h3><p>About it.</p><div class="meta"><span class="title">x</span><span>Kind</span><time datetime="2024-03-05">soon</time></div></a>'))
    rows = F.concat(F.lit('<a class="blog-directory__row" href="/cn/blog/P'), i, F.lit('"><p class="type-md"></p><p class="type-md-lg">Title '), i, F.lit('</p><p class="text-theme-text-sec">About it.</p><span>Mar 5</span><span>4 min read</span><span>Kind</span><time datetime="2024-03-05T00:00:00Z"></time></a>'))
    p = table(spark, d, "pages").select("page_id", F.when(k == 0, cards).when(k == 2, grid).when(k == 3, rows).when(k == 1, items).otherwise("<a href='/blog/x'>no entry</a>").alias("body"), F.when(k == 0, "cards").when(k == 2, "grid").when(k == 3, "directory").otherwise("list_items").alias("adapter"), F.lit("x").alias("slug"), F.lit("https://x.org/").alias("home"), F.lit("").alias("fetch"))
    out = listings.listing_rows(p, "body", "adapter", "slug", "home", "fetch", ["page_id"])
    return out.select("page_id", "error", "url", "title", "summary", "category", "published_at", "content_hash")


@query("SELECT CAST(greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(event_id) FROM events)) + 1 AS BIGINT) AS revision")
def hold_revision(spark, d):
    return cache.next_revision(table(spark, d, "orders").select(F.col("o_orderkey").alias("revision")), table(spark, d, "events").select(F.col("event_id").alias("revision")))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}' AS json FROM nation")
def status_lines(spark, d):
    return cache.status_json(table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")), ["n_name"])


# The columns of the given tables.
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
}


def _profile_sql() -> str:
    out = []
    for name, columns in _COLUMNS.items():
        for i, (c, kind) in enumerate(x.split(" ") for x in columns.split(", ")):
            out.append(f"SELECT '{name}' AS name, {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {name}")
    return " UNION ALL ".join(out)


@query(_profile_sql())
def table_columns(spark, d):
    """The columns of the tables with the numbers of their rows and nulls."""
    return cache.profiled({n: table(spark, d, n) for n in _COLUMNS}).drop("nullable")
