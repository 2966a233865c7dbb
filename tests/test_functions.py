import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomfeed.functions import text as X
from loomfeed.functions import urls as U
from loomfeed.functions import values as V


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, base, want",
    [
        ("HTTPS://User:pw@Example.ORG:443/a//b/?utm_source=x&b=2&a=1#f", "", "https://example.org/a/b?b=2&a=1"),
        ("http://example.org:8080", "", "http://example.org:8080/"),
        ("/x/y/", "https://example.org/a/", "https://example.org/x/y"),
        ("https://example.org/?q=&REF=1&fbclid=2", "", "https://example.org/?q="),
        ("https://example.org/a?x=1&amp;y=2", "", "https://example.org/a?x=1&y=2"),
        ("mailto:someone", "", None),
        ("", "", None),
        (None, "", None),
    ],
)
def test_canonical(raw, base, want):
    assert U.canonical(raw, base) == want


def test_canonical_sql_agrees(spark):
    rows = [("http://A.example.com/fr/8//?page=2&ref=x",), ("https://m.example.net/en/25#top",), ("https://x.org",), ("https://x.org/?utm_a=1",), (None,), ("no url",)]
    got = spark.createDataFrame(rows, "u string").select(U.canonical_url_sql(F.col("u")).alias("a"), U.canonical_url("u").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_shapes(spark):
    f = lambda u: (one(spark, u, lambda c: U.one_slug_below(c, "news", ("topics",))), one(spark, u, lambda c: U.under_prefix(c, "/news")))
    assert f("https://x.org/news/a") == (True, True)
    assert f("https://x.org/news/topics") == (False, True)
    assert f("https://x.org/newsroom/a") == (False, False)
    assert one(spark, "https://www.X.org/a", U.host_key) == "x.org"


def test_clean_text_keeps_the_last_run():
    assert X.clean_one("Q&A") == "Q&A"
    assert X.clean_one("<p>x</p> R&amp;D") == "x R&D"
    assert X.clean_one("a &lt;b&gt; c") == "a c"
    assert X.clean_one("a ,b", punctuation=True) == "a,b"
    assert X.clean_one("abcdef", 4) == "abc…"
    assert X.clean_one(None) == ""


def test_whitespace_and_escape(spark):
    assert one(spark, "a 　b\x00\x85c ", X.output_text) == "a b c"
    assert one(spark, None, X.output_text) == ""
    assert one(spark, "a*b_c", X.markdown_escape) == "a\\*b\\_c"
    assert one(spark, "x" * 12, lambda c: X.capped(c, 10)) == "x" * 9 + "…"


def test_truncate():
    assert X.truncate_one("short", 10) == ("short", False)
    text, cut = X.truncate_one("word " * 50, 42)
    assert cut and len(text) <= 42 and text.endswith("word…")


def test_untranslated(spark):
    f = lambda a, b, lang="zh-CN": spark.range(1).select(X.seems_untranslated(F.lit(a), F.lit(b), F.lit(lang))).first()[0]
    assert f("hello", "Hello ") and f("hello", "quite another text") and not f("hello", "你好") and not f("hello", "hello", "en")
    assert one(spark, " ZH_hans ", X.normalize_language) == "zh-CN"


def test_dates(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    f = lambda s: one(spark, s, lambda c: V.utc_text(V.parse_when(c, now)))
    assert f("2024-01-02T03:04:05Z") == "2024-01-02T03:04:05Z"
    assert f("2024-01-02T03:04:05+02:00") == "2024-01-02T01:04:05Z"
    assert f("Tue, 02 Jan 2024 03:04:05 GMT") == "2024-01-02T03:04:05Z"
    assert f("Jan 5, 2023") == "2023-01-05T00:00:00Z"
    assert f("Mar 5") == "2024-03-05T00:00:00Z"
    assert f("Dec 5") == "2023-12-05T00:00:00Z"
    assert f("soon") is None


def test_civil_days_have_23_and_25_hours(spark):
    def hours(day):
        a, b = spark.range(1).select(*V.day_bounds(F.lit(day).cast("date"))).first()
        return (b - a) / dt.timedelta(hours=1)

    assert (hours("2026-03-08"), hours("2026-11-01"), hours("2026-05-01")) == (23, 25, 24)


def test_hash_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(V.stable_hash(F.col("x"), F.col("y"), F.col("z")).alias("h")).distinct().count() == 2
    assert V.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert [one(spark, n, V.backoff_seconds, "int") for n in (1, 2, 9, 50)] == [60, 120, 15360, 15360]


def test_content_normalization_and_cut():
    assert X.normalize_content("a\u3000\u2003b\xa0c\u2028d\r\n\r\n\n\ne\x07f") == "a b c\nd\n\ne f"
    assert X.truncate_one("One two. Three four five", 20) == ("One two. Three…", True)
    assert X.truncate_one("Aaaaaaa bbbb. ccccccccccc", 16) == ("Aaaaaaa bbbb.…", True)
    assert X.truncate_one("abcdef", 1) == ("…", True) and X.truncate_one("abcdefgh", 4) == ("abc…", True)


def test_languages(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("EN_us",), ("zh-Hans-CN",), ("simplified_chinese",), ("fr",)], "s string")
    assert [r[0] for r in df.select(X.normalize_language(F.col("s"))).collect()] == ["en", "en", "en", "zh-CN", "zh-CN", None]
    assert [r[0] for r in df.select(X.normalize_language(F.col("s"), strict=False)).collect()][-1] == "en"


def test_dates():
    now = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)
    given = ["Tue, 02 Jan 2024 03:04:05 +0200", "2024-01-02T03:04:05.678Z", "2024-01-02", "January 2, 2024", "Jan 2, 2024", "2024/01/02", "Mar 5", "December 24", "soon", "", None]
    assert [V.parse_date(x, now) for x in given] == ["2024-01-02T01:04:05Z", "2024-01-02T03:04:05Z", *["2024-01-02T00:00:00Z"] * 4, "2024-03-05T00:00:00Z", "2023-12-24T00:00:00Z", None, None, None]
