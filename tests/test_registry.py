"""Every registered query of the engine runs, and equals its DuckDB twin where it has one."""

import html
import math

import duckdb
import pytest

from loomfeed.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    assert got
    if sql := registry.oracle_sql().get(name):
        cur = duck.execute(sql)
        at = [[x[0] for x in cur.description].index(c) for c in cols]
        assert got == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_rss_items_keep_the_summary(spark):
    got = {r.page_id: html.unescape(r.item.split("<description>")[1].split("</description>")[0]) for r in registry.queries()["rss_items"](spark, D).collect()}
    text = {r.page_id: " ".join((r.text or "").split()) for r in registry.queries()["extract_main"](spark, D).collect()}
    assert any(len(t) > 200 for t in text.values())
    for i, t in text.items():
        assert len(got[i]) <= 800 and (got[i] == t if len(t) <= 800 else got[i][:780] == t[:780]), i


def test_merge_sides_cover_all_orders(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(registry.state, "merge_by_either_key", lambda stored, batch, *a: sides.extend([stored, batch]) or batch)
    registry._merged(spark, D)
    orders = spark.read.parquet(f"{D}/orders.parquet")
    have = sides[0].select("id").union(sides[1].select("pos"))
    assert orders.selectExpr("o_orderkey AS id").subtract(have).count() == 0 and have.count() == orders.count()


def test_sitemaps_due_to_the_microsecond(spark, duck, tmp_path):
    times = ["2024-01-20 11:59:59.999999", "2024-01-20 12:00:00", "2024-01-20 12:00:00.000001", "2024-01-20 12:00:00.999999", "2024-01-20 12:00:01", None]
    rows = [(10 * i + k, t, kind) for i, t in enumerate(times) for k, kind in enumerate(("view", "error", None))]
    spark.createDataFrame(rows, "event_id long, t string, event_type string").selectExpr("event_id", "CAST(t AS timestamp_ntz) AS ts", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    sql = registry.oracle_sql()["sitemaps_due"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {r.event_id: r.due for r in registry.queries()["sitemaps_due"](spark, str(tmp_path)).collect()}
    assert got == dict(duck.execute(sql).fetchall())
