"""Rules of URLs, hosts, charsets, answers and state changes, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from loomfeed.functions import gates as G
from loomfeed.operators import transitions as T


def column(spark, make, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.g for r in df.select("i", make(F.col("v")).alias("g")).orderBy("i").collect()]


def test_links_are_encoded_or_refused(spark):
    cases = {
        "https://x.org/a'b": "https://x.org/a'b", "https://x.org/é^": "https://x.org/%C3%A9%5E", "https://x.org/a b\"<>`{}|\\": "https://x.org/a%20b%22%3C%3E%60%7B%7D%7C%5C", "  HTTP://X.org/%zz?q=[1]&r=(2)!*$,;+~#f@ ": "HTTP://X.org/%zz?q=[1]&r=(2)!*$,;+~#f@",
        "https://x.org/\x85": "https://x.org/", "https://x.org/a\x85b": "", "https://x.org/a\tb": "", "https://x.org/\x7f": "", "ftp://x.org/": "", "https:x.org": "", "https:///a": "", "https://u@x.org": "", "https://u:p@x.org": "", "https://:p@x.org": "", "https://@x.org/": "https://@x.org/", "https://:8/": "", "https://[::1]:8/x": "https://[::1]:8/x", "https://[x/": "", "": "", None: "",
    }
    assert column(spark, G.safe_http_url, list(cases)) == list(cases.values())


def test_fetched_form_of_urls(spark):
    cases = {
        "https://bücher.example/a": "https://xn--bcher-kva.example/a", "HTTPS://X.Org.:443?q#f": "https://x.org/?q", "http://x.org:0/": "http://x.org/", "http://x.org:/a": "http://x.org/a", "http://x.org:8080/": None, "http://x.org:443/": None, "https://x.org:70000/": None, "http://x.org:a/": None,
        "http://u@x.org/": None, "http://@x.org/": None, "http://[fe80::1%25eth0]/": None, "http://[2001:DB8:0:0::1]:80/x?": "http://[2001:db8::1]/x", "http://127.0.0.1/": "http://127.0.0.1/", "ftp://x.org/": None, "http:///a": None, "http://x.org/a\nb": None, "http://x.org/#": "http://x.org/", "http://[x]/": None, "x": None, "": None, None: None, "http://" + "a" * 70 + ".org/": None,
    }
    assert column(spark, G.fetch_url, list(cases)) == list(cases.values())
    hosts = {" X.org. ": "x.org", "[::1]": "::1", "::1": "::1", "10.0.0.1": "10.0.0.1", "BÜCHER.de": "xn--bcher-kva.de", "x.org/": None, "u@x.org": None, "x.org:80": None, "": None, None: None}
    assert column(spark, G.allowed_host, list(hosts)) == list(hosts.values())
    public = {"8.8.8.8": True, "10.1.2.3": False, "127.0.0.1": False, "169.254.1.1": False, "100.64.0.1": False, "::1": False, "fe80::1%eth0": False, "2606:4700::1111": True, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "x": None, None: None}
    assert column(spark, G.public_address, list(public)) == list(public.values())


def test_imports_keep_to_their_publisher(spark):
    below = {
        "https://x.org/blog/a": True, "http://www.x.org/blog/a/": True, "https://x.org/blog/a?q#f": True, "https://X.org/%62log//a": True, "https://x.org/blog/a/b": False, "https://x.org/blog/Tag": False, "https://x.org/blog/news/": False, "https://x.org/blog": False, "https://x.org/blogs/a": False, "https://y.org/blog/a": False, "ftp://x.org/blog/a": False,
        "https://x.org/blog/%20": False, "https://x.org/blog/a%2Fb": False, "https://x.org/blog/a+b%zz": True, "": False, None: False,
    }
    prefix = F.lit("https://www.x.org/blog/")
    assert column(spark, lambda u: G.import_allowed(u, prefix, F.array().cast("array<string>")), list(below)) == list(below.values())
    hosts = F.array(F.lit("WWW.x.org"), F.lit("y.org"))
    assert column(spark, lambda u: G.import_allowed(u, F.lit(""), hosts), ["https://x.org/any/where", "https://www.y.org", "https://z.org/", "x.org", None]) == [True, True, False, False, False]
    root = {"https://x.org/blog": True, "http://www.x.org/blog//": True, "https://x.org/blog?q": False, "https://x.org/blog/a": False, "https://y.org/blog": False, None: False}
    assert column(spark, lambda u: G.section_root(u, prefix), list(root)) == list(root.values())


ANSWER = {"id": "r", "model": "m", "object": "chat.completion", "choices": [{"index": 0, "finish_reason": "stop", "message": {"role": "assistant", "content": "x", "refusal": None}}], "usage": {}}


def answer(choice=None, message=None, **top):
    out = json.loads(json.dumps(ANSWER)) | top
    if choice or message:
        out["choices"][0] |= choice or {}
        if message:
            out["choices"][0]["message"] |= message
    return json.dumps(out)


def test_answers_that_cannot_be_used(spark):
    typed = {"metadata": {"error_type": " Provider_Overloaded "}}
    cases = [
        (answer(), "ok"), (answer({"finish_reason": "length"}, {"refusal": "no"}), "refusal"), (answer({"finish_reason": "length"}, {"refusal": " "}), "finish_length"), (answer({"finish_reason": None}), "finish_reason"), (answer(message={"refusal": ["x"]}), "refusal"), (answer(id=" "), "response_id"), (answer(id=None), "response_id"),
        (answer(model="other"), "response_model"), (answer(object=None), "response_object"), (answer(choices=[]), "response_choices"), (answer(choices=None), "response_choices"), (answer(choices=[1]), "response_choice"), (answer({"index": None}), "response_choice"), (answer({"message": "x"}), "response_message"), (answer({"message": None, "finish_reason": "length"}), "finish_length"),
        (answer(message={"role": "user", "tool_calls": [1]}), "response_role"), (answer(message={"tool_calls": [1]}), "tool_calls"), (answer(message={"tool_calls": []}), "ok"), (answer(message={"reasoning_content": "a"}), "thinking_output"), (answer(message={"reasoning": "\n"}), "ok"), (answer(message={"reasoning_details": [{}]}), "thinking_output"), (answer(message={"reasoning_details": []}), "ok"),
        (answer(usage={"completion_tokens_details": {"reasoning_tokens": 2}}), "thinking_tokens"), (answer(message={"content": None}), "no_output"), (answer(message={"content": 5}), "no_output"), (answer(error={"x": 1}), "provider_error"), (answer(error={}), "ok"), (answer(error=""), "ok"),
        (answer({"finish_reason": "error", "error": typed}), "provider_overloaded"), (answer({"finish_reason": "stop", "error": typed}), "provider_error"), (answer({"finish_reason": "error", "error": "text"}), "provider_error"), (answer({"finish_reason": "error", "error": {"metadata": {"error_type": "new"}}}), "provider_error"), (answer({"finish_reason": "error", "error": typed}, error="x"), "provider_error"), ("[", "response_json"), (None, "response_json"), ("[]", "response_id"),
    ]
    got = column(spark, lambda v: G.completion_code(v, F.lit(None).cast("string"), ["m"], ["provider_overloaded"]), [c for c, _ in cases])
    assert [(c, g) for (c, _), g in zip(cases, got)] == cases
    assert column(spark, lambda v: G.completion_code(v, F.lit("filtered"), ["m"], []), [answer(error="x")]) == ["filtered"]


@pytest.mark.parametrize("header,body,want", [
    ("text/html; charset=ISO-8859-1", b"", "iso8859-1"), ('text/html; Charset="UTF-16LE"', b"\xef\xbb\xbf", "utf-16-le"), ("text/html; charset=unknown", b"\xef\xbb\xbfx", "utf-8"), (None, b"\xff\xfea\0", "utf-16-le"), (None, b"\xfe\xff\0a", "utf-16-be"), (None, b'<meta charset=" Windows-1252 ">', "cp1252"),
    (None, b'<META content="text/html; charset=koi8-r" http-equiv=Content-Type>', "koi8-r"), (None, b'<!-- <meta charset="koi8-r"> --><title>', "utf-8"), (None, b" " * 4096 + b'<meta charset="koi8-r">', "utf-8"), (None, b'<meta name=description content="x; charset=koi8-r">', "utf-8"), (None, None, "utf-8"), ("text/html", b"<meta charset=none>", "utf-8"),
])
def test_charsets(header, body, want):
    assert G.charset_one(header, body) == want


def test_marks_write_what_comes(spark):
    seen = spark.createDataFrame([("s", "u1", "2024-01-01"), ("s", "u2", "2024-01-01"), ("s", "u3", "")], "s string, u string, m string")
    entries = spark.createDataFrame([("s", "u1", None, 1), ("s", "u2", "2024-02-02", 1), ("s", "u2", "2023-05-05", 2), ("s", "u4", "x", 1)], "s string, u string, m string, p int")
    pending = spark.createDataFrame([("s", "u2"), ("s", "u9")], "s string, u string")
    out, left = T.mark_seen(seen, pending, entries, ["s", "u"], "m", "p")
    assert {(r.u, r.m) for r in out.collect()} == {("u1", ""), ("u2", "2023-05-05"), ("u3", ""), ("u4", "x")}
    assert [r.u for r in left.collect()] == ["u9"]


def test_checks_of_new_keys_begin_a_streak(spark):
    state = spark.createDataFrame([("a", 1, 1, 2, "old"), ("b", 1, 1, 2, "old")], "k string, checked_at int, ok_at int, failures long, error string")
    runs = spark.createDataFrame([("a", 5, "failure", "e5"), ("new", 5, "failure", "e5"), ("new", 6, "failure", "e6"), ("fine", 7, "ok", None), ("back", 7, "failure", "x"), ("back", 8, "ok", "y")], "k string, at int, outcome string, error string")
    got = {r.k: (r.checked_at, r.ok_at, r.failures, r.error) for r in T.record_checks(state, runs, "k").collect()}
    assert got == {"a": (5, 1, 3, "e5"), "b": (1, 1, 2, "old"), "new": (6, None, 2, "e6"), "fine": (7, 7, 0, None), "back": (8, 8, 0, None)}


def test_a_moved_source_refuses_the_configuration(spark):
    stored = spark.createDataFrame([("a", "h", "f", "n", "tag", "2024"), ("b", "h", "f", "n", "tag", None), ("c", "h", "f", "n", "tag", "2024")], "slug string, home string, feed string, name string, etag string, since string")
    sync = lambda *rows: {r.slug: (r.home, r.feed, r.name, r.etag, r.change) for r in T.sync_configs(stored, spark.createDataFrame(list(rows), "slug string, home string, feed string, name string"), "slug", ["home", "feed"], ["name"], "feed", ["etag"], "since").collect()}
    assert sync(("a", "h", "f", "new"), ("b", "H", "F", "n"), ("d", "h", "f", "n")) == {"a": ("h", "f", "new", "tag", "updated"), "b": ("H", "F", "n", None, "updated"), "c": ("h", "f", "n", "tag", "absent"), "d": ("h", "f", "n", None, "inserted")}
    assert sync(("a", "h", "other", "n"), ("b", "H", "F", "n"), ("c", "h", "f", "n"), ("d", "h", "f", "n")) == {"a": ("h", "f", "n", "tag", "conflict"), "b": ("h", "f", "n", "tag", "refused"), "c": ("h", "f", "n", "tag", "kept")}


def test_holds_are_settled_by_the_right_success(spark):
    holds = [(f"{c}{int(p)}", k, c, p) for k in ("none", "summary", "title", "both") for c in ("ambiguous", "paid_failure", "fallback_pending") for p in (False, True)]
    done = [("summary", "summary", []), ("title", "translation", ["title"]), ("both", "translation", ["publisher_summary", "title"]), ("both", "summary", [])]
    left = T.clear_after_success(spark.createDataFrame(holds, "h string, k string, hold_class string, legacy_pair boolean"), spark.createDataFrame(done, "k string, task string, fields array<string>"), ["k"])
    want = {(h, k) for h, k, c, p in holds if k == "none" or k != "both" and p or k == "summary" and c == "ambiguous"}
    assert {(r.h, r.k) for r in left.collect()} == want
