"""Registered queries over tables with versions and checks of whole publications, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, table
from ..sources import versions
from .registry import _ts, query
from .streams import _stream


def _added(content: DataFrame, rows: DataFrame) -> DataFrame:
    """Customers' totals with those of rows added, and the revision of those that changed raised."""
    new = rows.groupBy("custkey").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.lit(1).cast("long").alias("revision"))
    return content.unionByName(new).groupBy("custkey").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "cents", "revision")])


def _orders(spark, d, status: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("custkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query("SELECT o_custkey AS custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS revision FROM orders GROUP BY 1")
def fenced_writers(spark, d):
    """Three writers add their orders to a table; one loses a race and tries again, one sends its batch twice. Each order counts once."""
    t = versions.VersionedTable(spark, fresh_path(spark, "versions"), "custkey long, n long, cents long, revision long")
    stale = t.version()
    t.change(lambda content: _added(content, _orders(spark, d, "F")), batch=("filled", 1))
    try:
        t.commit(_added(t.read(stale), _orders(spark, d, "O")), stale, batch=("open", 1))
        raise AssertionError("a stale commit went through")
    except versions.Conflict:
        t.change(lambda content: _added(content, _orders(spark, d, "O")), batch=("open", 1))
    for _ in range(2):
        t.change(lambda content: _added(content, _orders(spark, d, "P")), batch=("part", 7))
    return t.read()


@query("""WITH s AS (SELECT o_custkey AS custkey, row_number() OVER (ORDER BY o_custkey) AS revision, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders GROUP BY 1),
t AS (SELECT *, (SELECT max(revision) FROM s) AS top, sum(CASE WHEN filled > 0 THEN 1 ELSE 0 END) OVER (ORDER BY custkey) AS nth FROM s)
SELECT custkey, n - filled AS n, CAST(CASE WHEN filled > 0 THEN top + nth ELSE revision END AS BIGINT) AS revision FROM t""")
def fenced_revisions(spark, d):
    """Sending takes the filled orders off each customer's count, if every row still has the revision that was seen and nothing has been written since; a second sender with the old fence is refused."""
    from ..operators.scan import running

    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    first = running(n, [], [F.col("custkey")], {"revision": ("count", None)})
    t = versions.VersionedTable(spark, fresh_path(spark, "versions"), "custkey long, n long, filled long, revision long")
    t.change(lambda _: first)
    seen = t.read()
    fence = seen.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("t")).first()["t"]
    asked = seen.where("filled > 0").select("custkey", "revision")
    for _ in range(2):
        try:
            versions.fenced_update(t, asked, "custkey", "revision", {"n": F.col("n") - F.col("filled")}, fence=fence)
        except versions.Refused:
            continue
    return t.read().select("custkey", "n", "revision")


@query("SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last FROM events GROUP BY 1")
def stream_committed(spark, d):
    """A stream of events merged into a table, one version a batch; running it again from its start under the same writer changes nothing."""
    path = fresh_path(spark, "versions")
    t = versions.VersionedTable(spark, path, "user_id long, n long, last timestamp")

    def merge(content: DataFrame, rows: DataFrame) -> DataFrame:
        new = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("last").alias("last"))
        return content.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    for again in ("a", "b"):
        versions.committed_stream(_stream(spark, d, "events").select("user_id", _ts("ts").alias("last")), t, "events", f"{path}-state-{again}", merge)
    return t.read().select("user_id", "n", F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last"))
