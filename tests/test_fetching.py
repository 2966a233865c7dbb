from pyspark.sql import functions as F

from loomfeed.operators import fetching

RESPONSES = {
    "https://x.org/ok": (200,), "https://x.org/r0": (301, "/r1"), "https://x.org/r1": (302, "r2"), "https://x.org/r2": (303, "https://x.org:443/r3#f"), "https://x.org/r3": (307, "//x.org/r4"), "https://x.org/r4": (308, "/r5"), "https://x.org/r5": (302, "/ok"), "https://x.org/self": (302, ""), "https://x.org/none": (302, None), "https://x.org/a": (302, "/b"), "https://x.org/b": (302, "/a"),
    "https://x.org/out": (302, "https://y.org/"), "https://x.org/bad": (302, "http://u@x.org/"), "https://x.org/lost": (302, "/missing"), "https://x.org/404": (404,), "https://x.org/null": (None,), "http://[::1]/v6": (302, "https://x.org/ok"),
    "https://x.org/png": (200, None, "image/png"), "https://x.org/notype": (200, None, None), "https://x.org/gz": (200, None, "text/html", "gzip"), "https://x.org/len": (200, None, "text/html", "", "many"), "https://x.org/neg": (200, None, "text/html", None, "-1"), "https://x.org/big": (200, None, "text/html", None, "101"), "https://x.org/bigger": (200, None, "application/xhtml+xml;x", "IDENTITY", " 5 ", 101),
}
DEFAULT = (None, None, "Text/HTML ; charset=x", None, None, 10)
WANT = {
    "https://x.org/ok": ("https://x.org/ok", 0, "ok"), "https://X.org/r1#a": ("https://x.org/ok", 5, "ok"), "https://x.org/r0": ("https://x.org/r5", 5, "too_many_redirects"), "https://x.org/none": ("https://x.org/none", 0, "no_location"), "https://x.org/self": ("https://x.org/self", 0, "no_location"), "https://x.org/a": ("https://x.org/a", 2, "loop"), "https://x.org/out": ("https://y.org/", 1, "not_allowed"), "https://x.org/bad": (None, 1, "invalid_url"),
    "https://x.org/lost": ("https://x.org/missing", 1, "no_response"), "https://x.org/404": ("https://x.org/404", 0, "status_404"), "https://x.org/null": ("https://x.org/null", 0, "no_response"), "ftp://x.org/": (None, 0, "invalid_url"), None: (None, 0, "invalid_url"), "http://[0:0::1]/v6": ("https://x.org/ok", 1, "ok"), "https://x.org/png": ("https://x.org/png", 0, "content_type"), "https://x.org/notype": ("https://x.org/notype", 0, "content_type"),
    "https://x.org/gz": ("https://x.org/gz", 0, "encoding"), "https://x.org/len": ("https://x.org/len", 0, "length"), "https://x.org/neg": ("https://x.org/neg", 0, "length"), "https://x.org/big": ("https://x.org/big", 0, "too_large"), "https://x.org/bigger": ("https://x.org/bigger", 0, "too_large"),
}


def test_redirects_are_followed_by_their_rules(spark):
    rows = [(u, *r, *DEFAULT[len(r) :]) for u, r in RESPONSES.items()]
    responses = spark.createDataFrame(rows, "url string, status int, location string, content_type string, content_encoding string, content_length string, n_bytes long")
    requests = spark.createDataFrame([(i, u, ["x.org", "::1"]) for i, u in enumerate(WANT)], "id int, url string, hosts array<string>")
    got = {r.id: (r.final_url, r.hops, r.outcome) for r in fetching.followed(requests, responses, "hosts", most_bytes=100).collect()}
    assert [got[i] for i in range(len(WANT))] == list(WANT.values())
    none = spark.createDataFrame([(0, "https://x.org/ok", None), (1, "https://x.org/ok", [])], "id int, url string, hosts array<string>")
    assert {r.outcome for r in fetching.followed(none, responses, "hosts").collect()} == {"not_allowed"}
    assert fetching.followed(requests.limit(0), responses, "hosts").count() == 0


def test_steps_after_a_response(spark):
    cases = [(200, None, 1, "ok"), (304, None, 1, "not_modified"), (503, None, 1, "retry"), (503, 10.0, 1, "retry"), (503, 10.5, 1, "failed"), (503, None, 2, "failed"), (404, None, 1, "failed"), (501, 0.0, 1, "failed"), (None, None, 1, "failed")]
    df = spark.createDataFrame(cases, "s int, w double, a int, want string")
    assert all(r.got == r.want for r in df.select("want", fetching.response_step(F.col("s"), F.col("w"), F.col("a")).alias("got")).collect())


def test_snapshots_serve_reads(spark):
    snapshots = spark.createDataFrame([(1, 1, "t1", "u", "v2"), (2, 1, "t2", "u", "v1"), (3, 2, "t1", "u", "v1"), (4, 2, "t1", "u", "v2"), (5, 3, "t1", "old", "v2"), (6, 4, "t1", "u", "v2")], "id long, article_id long, retrieved_at string, canonical_url string, extractor_version string")
    requests = spark.createDataFrame([(1, "u", False), (2, "u", None), (3, "u", False), (4, "u", True), (5, "u", False)], "article_id long, url string, refresh boolean")
    got = {r.article_id: (r.snapshot_id, r.step) for r in fetching.read_through(requests, snapshots, "fetch_on_demand_cached_local", "v2").collect()}
    assert got == {1: (None, "fetch_and_store"), 2: (4, "cached"), 3: (None, "fetch_and_store"), 4: (None, "fetch_and_store"), 5: (None, "fetch_and_store")}
    assert {r.step for r in fetching.read_through(requests, snapshots, "fetch_on_demand", "v2").collect()} == {"fetch"}
    assert {r.step for r in fetching.read_through(requests, snapshots, "metadata_only", "v2").collect()} == {"refused"}
