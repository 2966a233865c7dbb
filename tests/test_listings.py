import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomfeed.functions import artifacts as A
from loomfeed.operators import cache
from loomfeed.sources import config
from loomfeed.sources.html import parse
from loomfeed.sources.listings import ADAPTERS, LAYOUTS, Site, article, localized, read_listing, read_locale

SITE = Site("x", "https://x.org/", "https://cdn.y.net/feed")
NOW = datetime(2024, 6, 1, tzinfo=UTC)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("/blog/a?ref=z", "https://x.org/blog/a"), ("https://www.x.org/blog/a", "https://www.x.org/blog/a"), ("https://cdn.y.net/blog/a", "https://cdn.y.net/blog/a"), ("https://z.org/blog/a", None), ("/blog/tag", None), ("/blog/.a", None), ("/blog/a/b", None), ("/news/a", None), ("mailto:a@x.org", None), (None, None), ("", None)],
)
def test_article_gate(raw, want):
    assert article(SITE, raw, "blog") == want


def test_localized_gate():
    assert localized(SITE, "/cn/blog/Big-News", "blog") == localized(SITE, "https://www.x.org/blog/big-news", "blog") == "https://x.org/blog/big-news"
    assert [localized(SITE, u, "blog") for u in ("/fr/blog/a", "/cn/blog/tag", "/cn/blog", "", None)] == [None] * 5


def test_cards_fall_back_and_merge():
    page = (
        '<a class="resource-item" href="/blog/a"><h3>Short</h3><p>One , two</p><span>Jan 5, 2024</span></a>'
        '<a class="Resource-Item big" href="/blog/a?utm_x=1"><img alt=""><div class="x line-clamp-2">A longer title</div><p></p></a>'
        '<a class="resource-item" href="/blog/none"></a><a href="/blog/b"><h3>plain link</h3></a>'
    )
    error, (row,) = read_listing(page, "cards", SITE, NOW)
    assert error is None
    assert (row["title"], row["summary"], row["published_at"], row["external_id"]) == ("A longer title", "One, two", "2024-01-05T00:00:00Z", "https://x.org/blog/a")


def test_list_items_take_the_first_valid_link():
    page = '<div role="ListItem" class="marquee_cms_blog_list_item"><a href="https://other.org/blog/q">x</a><a href="/blog/q" data-cta-copy="From link">go</a><p class="card-excerpt">E</p><i fs-list-field="Date">June 3</i></div><div role="listitem"><a href="/blog/r">no class</a></div>'
    _, (row,) = read_listing(page, "list_items", SITE, NOW)
    assert (row["url"], row["title"], row["summary"], row["published_at"]) == ("https://x.org/blog/q", "From link", "E", "2024-06-03T00:00:00Z")


def test_grid_subject_and_year():
    page = '<a class="FeaturedGrid" href="/news/n"><span class="subtitle">s</span><h2>Head</h2><div class="subject">Policy</div><p>P</p><span>December 30</span></a>'
    _, (row,) = read_listing(page, "grid", SITE, NOW)
    assert (row["title"], row["category"], row["published_at"]) == ("Head", "Policy", "2023-12-30T00:00:00Z")


def test_directory_and_locale():
    page = '<a class="card card--feature" href="/cn/blog/One"><p class="type-base text-theme-text text-pretty">标题</p><p class="text-theme-text-sec">摘要</p><span>·</span><span>Aug 1</span><span>5 min</span><span>Product</span></a><a class="blog-directory__row" href="/cn/blog/one"><p class="type-md">again</p></a><a class="blog-directory__row" href="/cn/blog/two"><p class="type-md">English</p></a><a class="blog-directory__row" href="/blog/kana"><p class="type-md">カタカナ</p></a>'
    _, rows = read_listing(page, "directory", SITE, NOW)
    assert [(r["url"], r["title"], r["category"]) for r in rows] == [("https://x.org/blog/one", "标题", "Product"), ("https://x.org/blog/two", "English", ""), ("https://x.org/blog/kana", "カタカナ", "")]
    assert read_locale(page, SITE) == {"one": ("标题", "摘要")}
    assert read_locale(None, SITE) == read_locale(" ", SITE) == {}


def test_markdown_before_cards():
    text = "# Posts\n- [A](/blog/a.md): about , it\n* [B](/blog/b.md)\n- [C](/blog/c)\n- [T](/blog/tag.md)"
    assert [(r["title"], r["url"], r["summary"]) for r in read_listing(text, "markdown_or_cards", SITE)[1]] == [("A", "https://x.org/blog/a", "about, it")]
    assert read_listing('<a class="resource-item" href="/blog/a"><h3>A</h3></a>', "markdown_or_cards", SITE)[1][0]["title"] == "A"


def test_errors_and_odd_pages():
    assert read_listing(None, "cards", SITE) == ("empty body", [])
    assert read_listing("x", None, SITE)[0] == "unsupported adapter: None"
    assert read_listing("<p>x</p>", "grid", SITE) == ("grid found no articles", [])
    assert read_listing("<!DOCTYPE a><rss/>", "rss", SITE)[0].startswith("rss: ")
    assert read_listing("<div>" * 2000, "cards", SITE)[0]
    assert list(LAYOUTS["cards"].entries(parse(""), SITE)) == []


def test_feeds_pass_the_same_gate():
    rss = "<rss><channel><item><guid> g  1 </guid><title>T</title><link>https://x.org/a</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>Else</title><link>https://z.org/a</link></item></channel></rss>"
    _, (row,) = read_listing(rss, "rss", SITE)
    assert (row["external_id"], row["published_at"]) == ("g 1", "2024-01-02T03:04:05Z")


def test_sources(spark):
    good = {"slug": " a ", "name": "A", "fetch_url": "https://x.org", "adapter": "rss"}
    df = config.sources_table(spark, json.dumps({"sources": [good, {**good, "slug": "b", "history_limit": 500, "enabled": False}]}), ADAPTERS)
    assert [tuple(r) for r in df.select("position", "slug", "history_limit", "sitemap_interval_hours", "enabled").orderBy("position").collect()] == [(0, "a", 50, 24, True), (1, "b", 500, 24, False)]
    for change, word in (({"slug": ""}, "slug is required"), ({"adapter": "z"}, "unsupported"), ({"history_limit": 501}, "history_limit"), ({"sitemap_interval_hours": 0}, "interval"), ({"sitemap_url": "u"}, "together")):
        with pytest.raises(ValueError, match=word):
            config.read_sources(json.dumps({"sources": [{**good, **change}]}), ADAPTERS)
    with pytest.raises(ValueError, match="used twice"):
        config.read_sources(json.dumps({"sources": [good, good]}), ADAPTERS)
    for bad in ({}, {"sources": []}, {"sources": [1]}):
        with pytest.raises(ValueError, match="not empty"):
            config.read_sources(json.dumps(bad), ADAPTERS)


def _short(**change):
    return json.dumps({"summary": "s", "key_points": ["a"], "language": "en", "basis": "metadata", "limitations": ""} | change)


def _checked(spark, task, texts, language="en", **options):
    """(error, readable) of each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", A.checked_output(F.lit(task), F.col("t"), F.lit(language), **options).alias("r")).orderBy("i").collect()
    return [(r.r.error, r.r.readable) for r in got]


def test_summaries(spark):
    good = [_short(), _short(summary=" e\u0301\x01 "), _short(key_points=[]), _short(key_points=[" a\n", "e\u0301\x02b"])]
    assert _checked(spark, "summary", good) == [(None, "s\n• a"), (None, "é\n• a"), (None, "s"), (None, "s\n• a\n• éb")]
    bad = {"another basis": {"basis": "full"}, "key_points is no list of at most six": {"key_points": ["a"] * 7}, "key_points is empty": {"key_points": [""]}, "key_points is no text": {"key_points": ["a", 1]}, "key_points is too long": {"key_points": ["x" * 601]}, "summary is no text": {"summary": 1}, "summary is too long": {"summary": "x" * 2401}, "another language": {"language": "zh-CN"}, "keys differ from the contract": {"more": 1}, "summary is empty": {"summary": " \n"}, "limitations is no text": {"limitations": None}}
    assert _checked(spark, "summary", [_short(**c) for c in bad.values()]) == [(e, None) for e in bad]
    assert _checked(spark, "summary", [_short(key_points="a")]) == [("key_points is no list of at most six", None)]
    assert [e for e, _ in _checked(spark, "summary", [None, "", "[]", "{", '{"a": 1, "a": 2}'])] == ["no JSON", "no JSON", "keys differ from the contract", "no JSON", "no JSON"]
    assert _checked(spark, "poem", [_short()]) == [("unknown task poem", None)]


def test_translations_of_some_fields(spark):
    make = lambda **c: json.dumps({"title": "t", "publisher_summary": None, "language": "en", "limitations": ""} | c)
    assert _checked(spark, "translation", [make()], fields=("title",)) == [(None, "t")]
    assert _checked(spark, "translation", [make(), make(publisher_summary="x")], empty_summary=True) == [(None, "t\n\n"), (None, "t\n\nx")]
    assert _checked(spark, "translation", [make(), make(publisher_summary="x")]) == [("publisher_summary is no text", None), (None, "t\n\nx")]
    assert _checked(spark, "translation", [make(publisher_summary="x"), make(title="")], fields=("title",)) == [("publisher_summary was not asked for", None), ("title is empty", None)]


def test_payload_corner_cases(spark):
    rows = [("translation", None, " ", None), ("summary", " t ", None, "legacy"), ("translation", None, "own", '{"summary":"o"}'), ("summary", None, None, "{broken"), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "task string, title string, summary string, output string").select(A.payload(*(F.col(c) for c in ("task", "title", "summary", "output"))).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [(None, None, None, []), ("t", None, "legacy", []), (None, "o", "o", []), (None, None, None, []), (None, None, None, [])]
    both = spark.createDataFrame([([("translation", "A", "s", None), ("summary", "B", "z", None)],)], "a array<struct<task:string,title:string,summary:string,output:string>>")
    assert both.select(A.translated_search_text(F.col("a"))).first()[0] == ["A", "s"]
    one = spark.createDataFrame([("Hello world again", "x")], "title string, summary string")
    fields = F.struct(F.col("title"), F.lit(None).cast("string").alias("publisher_summary"))
    assert one.select(A.artifact_untranslated(F.lit("translation"), F.lit("zh-CN"), fields, F.col("title"), F.col("summary"))).first()[0] is True


def test_imports_refuse_ambiguous_and_repeated(spark):
    given = spark.createDataFrame([("k1", "i1", "h"), ("k2", "twice", "h"), ("k3", None, "h"), ("k4", "i2", "h"), ("k4", "i2", "h"), ("k5", "i1", None)], "key string, who string, hash string")
    articles = spark.createDataFrame([("i1", 1), ("twice", 2), ("twice", 3), ("i2", 4)], "who string, article_id long")
    stored = spark.createDataFrame([("k5", None)], "key string, hash string")
    got = cache.import_cache(stored, given, articles, ["who"], "key", ["hash"], F.lit(False))
    assert sorted((r.key, r.outcome) for r in got.collect()) == [("k1", "insert"), ("k2", "unresolved"), ("k3", "unresolved"), ("k4", "repeated"), ("k4", "repeated"), ("k5", "present")]
    assert cache.import_cache(stored, given.limit(0), articles, ["who"], "key", ["hash"], F.lit(False)).count() == 0


def test_files_and_runs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    assert [(r.length, r.sha256[:8]) for r in cache.file_hashes(spark, str(tmp_path), "*.txt").collect()] == [(3, "ba7816bf")]
    for i in range(2):
        cache.append_run(spark.createDataFrame([(i,)], "run int"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    assert cache.next_revision(spark.createDataFrame([], "revision long"), spark.createDataFrame([], "revision long")).first()[0] == 1
