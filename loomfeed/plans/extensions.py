"""Registered queries through SQL extension points: a data source of recorded fetches, table functions; with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..session import fresh_path, table
from ..sources import recordings
from .registry import query

_HOSTNAME = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"


def recorded(spark, d) -> str:
    """All pages as recorded fetches; the folder."""
    recordings.register(spark)
    path = fresh_path(spark, "recordings")
    pages = table(spark, d, "pages")
    rows = pages.select(F.lit(None).cast("string").alias("host"), "url", F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("fetched_at"), F.when(F.col("page_id") % 17 == 0, 404).otherwise(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("body"))
    rows.write.format("recorded_fetches").mode("append").save(path)
    return path


@query(f"SELECT {_HOSTNAME} AS host, url, 'page-' || page_id AS fetched_at, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status, sha256(html) AS digest, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages")
def recorded_fetches(spark, d):
    """Pages written to web archives and read back."""
    rows = spark.read.format("recorded_fetches").load(recorded(spark, d))
    return rows.select("host", "url", "fetched_at", "status", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"))


_BUSY = f"(SELECT {_HOSTNAME} AS host FROM pages GROUP BY 1 HAVING host IS NOT NULL ORDER BY count(*) DESC, host LIMIT 2)"


@query(f"SELECT {_HOSTNAME} AS host, url FROM pages WHERE {_HOSTNAME} IN {_BUSY}")
def fetches_of_hosts(spark, d):
    """The recorded fetches of the two busiest hosts, from the files of their shards alone."""
    path = recorded(spark, d)
    busy = spark.read.format("recorded_fetches").load(path).where("host IS NOT NULL").groupBy("host").count().orderBy(F.desc("count"), "host").limit(2)
    hosts = [r.host for r in busy.collect()]
    return spark.read.format("recorded_fetches").load(path).where(F.col("host").isin(hosts)).select("host", "url")


_BARE = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"


@query(rf"""WITH a AS (SELECT page_id, unnest(regexp_extract_all({_BARE}, '(?is)<a\b[^>]*>.*?</a\s*>')) AS x, generate_subscripts(regexp_extract_all({_BARE}, '(?is)<a\b[^>]*>.*?</a\s*>'), 1) - 1 AS position FROM pages)
SELECT page_id, CAST(position AS INTEGER) AS position, replace(regexp_extract(x, '(?i)\bhref\s*=\s*"([^"]*)"', 1), '&amp;', '&') AS href FROM a""")
def sql_page_links(spark, d):
    """Links of all pages by a table function in SQL."""
    table_functions.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("_pages")
    return spark.sql("SELECT page_id, position, coalesce(href, '') AS href FROM _pages, LATERAL page_links(html)")
