"""Registered queries of canonical values, digests and schedules, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_values as J
from ..operators import merkle, spacing, subsets
from ..session import table
from .registry import _ts, query

_ORDER = """'{"customer":{"key":' || o_custkey || ',"priority":"' || o_orderpriority || '"},"list":[' || CASE WHEN o_orderstatus = 'F' THEN '"filled",' ELSE '' END || 'null,true],"order_key":' || {key} || ',"price":' || o_totalprice::VARCHAR || '}'"""


def _nested(spark, d):
    """Orders as nested JSON text with members in no order and with spaces."""
    o = table(spark, d, "orders")
    price = F.col("o_totalprice").cast("string")
    filled = F.when(F.col("o_orderstatus") == "F", F.lit('"filled" , ')).otherwise("")
    text = F.concat(F.lit('{ "price" : '), price, F.lit(',\n"list":[ '), filled, F.lit('null, true ], "order_key": '), F.col("o_orderkey").cast("string"), F.lit(', "customer": {"priority": "'), F.regexp_replace("o_orderpriority", "-", r"\\u002d"), F.lit('", "key": '), F.col("o_custkey").cast("string"), F.lit("}}"))
    return o.select("o_orderkey", text.alias("text"))


_PORTABLE = """'{"portable":' || o_orderkey % 10 || '}'"""


@query(f"SELECT o_orderkey, {_ORDER.replace('{key}', 'o_orderkey')} AS canonical, sha256({_ORDER.replace('{key}', 'o_orderkey')}) AS digest, {_ORDER.replace('{key}', _PORTABLE)} AS portable, 'customer,key,list,order_key,price,priority' AS members FROM orders")
def canonical_values(spark, d):
    """Canonical JSON of nested values, its digest, and the same with the local key replaced by a portable identity."""
    t = F.col("text")
    by = F.concat(F.lit('{"portable": '), (F.col("o_orderkey") % 10).cast("string"), F.lit("}"))
    return _nested(spark, d).select("o_orderkey", J.canonical_text(t).alias("canonical"), J.value_digest(t).alias("digest"), J.replaced(t, "order_key", by).alias("portable"), J.members(t).alias("members"))


@query("WITH e AS (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS i FROM events) SELECT event_id, event_type AS host, CAST(max(t - 1500 * i) OVER (PARTITION BY event_type ORDER BY i) + 1500 * i AS BIGINT) AS start FROM e")
def spaced_requests(spark, d):
    """Every event is a request to one of five hosts, each of which is asked every 25 minutes at most."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("host"), F.unix_seconds(_ts("ts")).alias("t"))
    return spacing.spaced(rows, "host", "t", "event_id", 1500).drop("t")


_WAIT = "CASE event_id % 4 WHEN 0 THEN CAST(event_id % 90 - 5 AS VARCHAR) WHEN 1 THEN strftime(ts + INTERVAL (event_id % 50 - 10) SECOND, '%a, %d %b %Y %H:%M:%S GMT') WHEN 2 THEN 'soon' END"


@query("SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN greatest(event_id % 90 - 5, 0) WHEN 1 THEN greatest(event_id % 50 - 10, 0) ELSE power(2, event_id % 6) + (event_id % 11) / 44.0 END, 6) AS wait FROM events")
def retry_waits(spark, d):
    """Waits after answers with seconds, dates, unusable and no Retry-After headers."""
    i, ts = F.col("event_id"), F.date_trunc("second", _ts("ts"))
    date = F.date_format(F.timestamp_seconds(F.unix_seconds(ts) + i % 50 - 10), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(i % 4 == 0, (i % 90 - 5).cast("string")).when(i % 4 == 1, date).when(i % 4 == 2, "soon")
    return table(spark, d, "events").select("event_id", F.round(spacing.retry_after(header, ts, (i % 6).cast("double"), (i % 11) / F.lit(11.0)), 6).alias("wait"))


_NAMES = ("digest", "key_points", "summary", "tags", "translation")
_CHOSEN = "list_filter([CASE WHEN doc_id % 2 = 0 THEN 'digest' END, CASE WHEN doc_id % 3 = 0 THEN 'key_points' END, CASE WHEN lang = 'en' THEN 'summary' END, CASE WHEN n_chars > 1000 THEN 'tags' END, CASE WHEN lang <> 'en' THEN 'translation' END], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, CASE WHEN doc_id % 9 <> 4 AND len(c) > 0 THEN array_to_string(c, '+') END AS tasks FROM (SELECT doc_id, {_CHOSEN} AS c FROM documents)")
def named_sets(spark, d):
    """Which tasks a document's fingerprint was made for; some fingerprints are of other tasks."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    chosen = F.filter(F.array(F.when(i % 2 == 0, "digest"), F.when(i % 3 == 0, "key_points"), F.when(F.col("lang") == "en", "summary"), F.when(F.col("n_chars") > 1000, "tags"), F.when(F.col("lang") != "en", "translation")), lambda x: x.isNotNull())
    asked = F.when(i % 9 == 4, F.array(F.lit("elsewhere"))).otherwise(chosen)
    rows = docs.select("doc_id", subsets.set_fingerprint(i, asked).alias("fingerprint"))
    return rows.select("doc_id", F.array_join(subsets.named_set(i, F.col("fingerprint"), list(_NAMES)), "+").alias("tasks"))


_ROW = "sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, ''), coalesce(lang, ''), coalesce(n_chars::VARCHAR, ''), coalesce(source, ''), coalesce(text, '')))"


@query(f"""WITH r AS (SELECT ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4096 AS node, {_ROW} AS h FROM documents),
l3 AS (SELECT node, count(*) AS n_rows, sha256(concat_ws(':', count(*), {', '.join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::HUGEINT)" for k in range(4))})) AS digest FROM r GROUP BY 1),
l2 AS (SELECT node // 16 AS p, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(node || '=' || digest, ',' ORDER BY node)) AS digest FROM l3 GROUP BY 1),
l1 AS (SELECT p // 16 AS q, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(p || '=' || digest, ',' ORDER BY p)) AS digest FROM l2 GROUP BY 1),
l0 AS (SELECT q // 16 AS s, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(q || '=' || digest, ',' ORDER BY q)) AS digest FROM l1 GROUP BY 1)
SELECT 3 AS level, node, n_rows, digest FROM l3 UNION ALL SELECT 2, p, n_rows, digest FROM l2 UNION ALL SELECT 1, q, n_rows, digest FROM l1 UNION ALL SELECT 0, s, n_rows, digest FROM l0""")
def digest_tree(spark, d):
    return merkle.digest_tree(table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source", "text"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 211 = 5 THEN 'removed' WHEN doc_id % 211 = 6 THEN 'changed' ELSE 'added' END AS change FROM (SELECT doc_id FROM documents WHERE doc_id % 211 IN (5, 6) UNION ALL SELECT -1 - doc_id FROM documents WHERE doc_id % 211 = 7)")
def located_changes(spark, d):
    """The few documents in which a publication differs from the one before it, found by their trees; all others are in leaves that agree or are told apart there."""
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    after = docs.where(i % 211 != 5).withColumn("n_chars", F.when(i % 211 == 6, F.coalesce("n_chars", F.lit(0)) + 1).otherwise(F.col("n_chars")))
    after = after.unionByName(docs.where(i % 211 == 7).withColumn("doc_id", -1 - i))
    return merkle.changes(docs, after, ["doc_id"])
