"""The data source of recorded fetches and the table functions of SQL."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from loomfeed.functions import table_functions
from loomfeed.sources import recordings as R

ROWS = [(f"http://h{i % 7}.example.org/p/{i}?q=é", f"2024-01-{i % 28 + 1:02d}T00:00:00Z", 200 if i % 3 else 304, "text/html", (f"body {i} \r\n\r\n WARC/1.0 " * (i % 5)).encode()) for i in range(60)]
ROWS += [(None, None, None, None, None), ("not a url", "x\r\ny", 500, "a\nb", b"\x00\xff"), ("http://[bad", None, 1, None, b""), ("HTTP://User@H1.Example.ORG:81/x", "t", 200, None, b"z" * 300_000)]
SCHEMA = "url string, fetched_at string, status int, content_type string, body binary"


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".warc.gz"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    R.register(spark)
    path = str(tmp_path_factory.mktemp("fetches"))
    write(spark, ROWS, path)
    return path


def write(spark, rows, path, mode="append"):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("host", F.lit(None).cast("string"))
    df.select("host", *[c.split(" ")[0] for c in SCHEMA.split(", ")]).write.format("recorded_fetches").mode(mode).save(path)


def clean(row):
    url, at, status, kind, body = row
    flat = lambda s: " ".join(s.split()) if s is not None else None
    return (R.host_of(url), flat(url), flat(at), status, flat(kind), body or b"")


def test_what_is_recorded_is_read_back(spark, folder):
    got = [(*r[:5], bytes(r.body)) for r in spark.read.format("recorded_fetches").load(folder).collect()]
    assert sorted(got, key=repr) == sorted(map(clean, ROWS), key=repr)
    assert R.host_of(ROWS[-1][0]) == "h1.example.org" and R.host_of("http://[bad") is None
    assert not [f for d, _, names in os.walk(folder) for f in names if f.startswith("_")]
    with gzip.open(files(folder)[0]) as f:
        assert f.readline() == b"WARC/1.0\r\n"


def test_a_filter_for_hosts_opens_their_files_only(spark, folder):
    every = spark.read.format("recorded_fetches").load(folder)
    few = every.where("host = 'h3.example.org'")
    assert len(files(folder)) == every.rdd.getNumPartitions() > few.rdd.getNumPartitions()
    assert sorted(r.url for r in few.collect()) == sorted(u for u, *_ in ROWS if R.host_of(u) == "h3.example.org")
    two = every.where(F.col("host").isin("h3.example.org", "h4.example.org") & (F.col("status") == 200))
    assert {r.host for r in two.collect()} == {"h3.example.org", "h4.example.org"} and all(r.status == 200 for r in two.collect())
    assert every.where("host = 'h3.example.org' AND host = 'h4.example.org'").count() == 0
    assert every.where("host = 'unknown'").count() == 0


def test_overwrite_and_empty_folders(spark, tmp_path):
    R.register(spark)
    path = str(tmp_path / "f")
    assert spark.read.format("recorded_fetches").load(path).count() == 0
    write(spark, ROWS[:10], path)
    write(spark, ROWS[10:15], path)
    assert spark.read.format("recorded_fetches").load(path).count() == 15
    write(spark, ROWS[20:24], path, "overwrite")
    assert {r.url for r in spark.read.format("recorded_fetches").load(path).collect()} == {r[0] for r in ROWS[20:24]}
    write(spark, [], path)
    assert spark.read.format("recorded_fetches").load(path).count() == 4


def test_large_files_are_parted_and_broken_ones_raise(spark, tmp_path, monkeypatch):
    data = b"".join(R.to_record(*r) for r in ROWS[:5])
    assert len(list(R.records(gzip.open(__import__("io").BytesIO(data))))) == 5
    whole = gzip.decompress(data)
    with pytest.raises(EOFError):
        list(R.records(__import__("io").BytesIO(whole[: len(whole) - 20])))
    with pytest.raises(ValueError):
        list(R.records(__import__("io").BytesIO(b"something else\r\n")))
    monkeypatch.setattr(R, "FILE_BYTES", 1)
    writer = R._Writer(f"file://{tmp_path}/w", False)
    rows = R._batch([clean(r) for r in ROWS[:6]])
    writer.commit([writer.write(iter([rows])), None])
    assert len(files(tmp_path / "w")) == 6
    lost = writer.write(iter([rows]))
    writer.abort([lost])
    assert len(files(tmp_path / "w")) == 6 and not [f for d, _, names in os.walk(tmp_path / "w") for f in names if f.startswith("_")]


def test_table_functions_in_sql(spark):
    table_functions.register(spark)
    html = '<!-- <a href="no">c</a> --><script>"<a href=x>y</a>"</script><a href="/a?x=1&amp;y=2">One <b>two</b>&nbsp;3</a><A HREF=\'b\'>\n</A><a name=q>bare</a><p>'
    spark.createDataFrame([(1, html), (2, None), (3, "")], "i int, html string").createOrReplaceTempView("_t")
    got = [tuple(r) for r in spark.sql("SELECT i, position, href, label FROM _t, LATERAL page_links(html) ORDER BY i, position").collect()]
    assert got == [(1, 0, "/a?x=1&y=2", "One two 3"), (1, 1, "b", ""), (1, 2, None, "bare")]
    text = "# One\ntext # no\n   ###  Three ##\n####### seven\n#none\n## \n"
    spark.createDataFrame([(1, text), (2, None)], "i int, t string").createOrReplaceTempView("_m")
    got = [tuple(r) for r in spark.sql("SELECT position, heading, level FROM _m, LATERAL markdown_headings(t) ORDER BY position").collect()]
    assert got == [(0, "One", 1), (1, "Three", 3), (2, "", 2)]
