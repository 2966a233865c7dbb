"""Exports, gates, queue steps and imports, case by case."""

import hashlib
import json

from pyspark.sql import functions as F

from loomfeed.functions import json_values as J
from loomfeed.functions import rules as R
from loomfeed.operators import exports, subsets, workflow


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_only_current_own_outputs_leave(spark):
    base = ("summary", "zh-CN", "succeeded", "metadata", None, None, "h1", "t1", "p")
    change = lambda **c: tuple(c.get(k, v) for k, v in zip(("task", "lang", "status", "scope", "source", "snap", "hash", "at", "by"), base))
    rows = [(1, 1, *base), (2, 1, *change(at="t2", by="publisher")), (3, 1, *change(status="failed", at="t9")), (4, 1, *change(scope="full_text", at="t9")), (5, 1, *change(source=7, at="t9")), (6, 1, *change(snap=7, at="t9")), (7, 1, *change(hash="old", at="t9")), (8, 1, *change(task="digest", at="t9")), (9, 2, *base), (10, 3, *base), (11, 1, *change(at="t2", by="publisher")), (12, 1, *change(lang="ja"))]
    cols = "id long, article_id long, task_type string, target_language string, status string, input_scope string, source_artifact_id long, content_snapshot_id long, article_content_hash string, created_at string, provider string"
    artifacts = spark.createDataFrame(rows, cols).withColumns({"output": F.concat(F.lit('{"b": 1, "a": '), F.col("id").cast("string"), F.lit("}")), "prompt_hash": F.lit("ph"), "requested_model": F.lit("m")})
    articles = spark.createDataFrame([(1, "s", "e1", "u1", "h1"), (3, "unknown", "e3", "u3", "h1")], "id long, source_slug string, external_id string, canonical_url string, content_hash string")
    out = exports.exportable(artifacts, articles, spark.createDataFrame([("s", "S")], "slug string, name string"))
    assert sorted(r.id for r in out.collect()) == [1, 2, 11, 12] and {r.source_name for r in out.collect()} == {"S"}
    got = {r.target_language: r for r in exports.published_artifacts(out, ["created_at", "provider", "prompt_hash", "requested_model", "output"]).collect()}
    zh = got["zh-CN"]
    assert set(got) == {"zh-CN", "ja"} and (zh.output_hash, zh.prompt_hash, zh.requested_model) == (sha('{"a":11,"b":1}'), sha("publisher"), "publisher") and (got["ja"].prompt_hash, got["ja"].requested_model) == ("ph", "m")
    whole = {k: v for k, v in zh.asDict().items() if k not in ("cache_key", "output")} | {"output": {"a": 11, "b": 1}}
    assert zh.cache_key == sha(J.canonical(whole))
    assert exports.published_artifacts(out.withColumn("output", F.lit("{")), ["created_at", "provider", "output"]).count() == 0


def test_an_invalid_newest_output_leaves_none(spark):
    artifacts = spark.createDataFrame([(1, 1, "t", "zh", "m", "succeeded", "h", "1", True), (2, 1, "t", "zh", "m", "succeeded", "h", "2", False), (3, 2, "t", "zh", "m", "succeeded", "h", "1", False), (4, 2, "t", "zh", "m", "succeeded", "h", "1", True), (5, 3, "t", "zh", "m", "succeeded", "old", "1", True), (6, 4, "t", "zh", "m", "succeeded", "h", "1", None)], "id long, article_id long, task_type string, target_language string, input_scope string, status string, article_content_hash string, created_at string, ok boolean")
    articles = spark.createDataFrame([(i, "h") for i in range(1, 5)], "id long, content_hash string")
    assert [r.id for r in exports.current_artifact(artifacts, articles, F.col("ok")).collect()] == [4]


def test_holds_leave_under_the_key_of_their_descriptor(spark):
    good = '{"b": [1], "a": "x"}'
    rows = [(sha('{"a":"x","b":[1]}'), good), (sha(good), good), (sha("[]"), "[]"), ("k", '{"a": {"prompt": 1}}'), ("k", '{"a":1,"a":2}'), ("k", '{"a":"' + "x" * 100 + '"}'), (None, good), ("k", None)]
    holds = spark.createDataFrame([(k, "article", "ambiguous", d, "t", "t", 1) for k, d in rows], "hold_key string, workload_kind string, hold_class string, descriptor string, created_at string, updated_at string, revision long")
    got = exports.hold_rows(holds, ("prompt",), longest=80)
    assert "revision" not in got.columns
    assert [r.error for r in got.collect()] == [None, "another key", "no JSON object", "forbidden member", "no JSON object", "too long", None, "no JSON object"]
    assert got.first().descriptor == '{"a":"x","b":[1]}'


def test_ids_give_way_to_identities(spark):
    text = json.dumps({"article_id": 1, "x": [{"article_id": 2, "y": {"article_id": True}}, {"article_id": "3"}]})
    df = spark.createDataFrame([(text, {1: '"one"', 2: '{"b":1,"a":2}'}), (text, {1: '"one"'}), ("[1]", None), ("{", {})], "t string, m map<long,string>")
    got = [r.p for r in df.select(J.portable(F.col("t"), "article_id", "who", F.col("m")).alias("p")).collect()]
    assert got == ['{"who":"one","x":[{"who":{"a":2,"b":1},"y":{}},{}]}', None, "[1]", None]


def test_gates_name_the_first_fault(spark):
    ok = ("name", "a" * 64, "2024-02-29T23:59:59Z", "zh-CN", 0)
    rows = [ok, ("", *ok[1:]), ("é", *ok[1:]), ("a\u0085", *ok[1:]), ("x" * 9, *ok[1:]), (None, *ok[1:]), ("é", "A" * 64, *ok[2:]), ("x", "a" * 63, *ok[2:]), (*ok[:2], "2023-02-29T00:00:00Z", *ok[3:]), (*ok[:2], "2024-01-01 00:00:00", *ok[3:]), (*ok[:3], "zh", 0), (*ok[:3], "", 0), (*ok[:4], -1), (*ok[:4], 10**15 + 1), (*ok[:4], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, key string, at string, language string, n long")
    rules = [R.text(F.col("name"), "name", 8), R.digest(F.col("key"), "key"), R.time(F.col("at"), "at"), R.language(F.col("language"), "language"), R.whole(F.col("n"), "n")]
    got = {r.i: r.error for r in R.violations(df, *rules).collect()}
    assert got == {1: "name has a bad length", 2: "name is not composed", 3: "name has a control character", 4: "name has a bad length", 5: "name is no text", 6: "key is no digest", 7: "key is no digest", 8: "at is no time", 9: "at is no time", 10: "language is no language", 11: "language has a bad length", 12: "n is out of range", 13: "n is out of range", 14: "n is no number"}


def test_snapshots_and_requests_are_checked(spark):
    snaps = [("k", "ambiguous", 1, None), ("", "ambiguous", 1, "key is empty"), ("k", "other", 1, "class is unknown"), ("k", None, 1, "class is unknown"), ("k", "paid_failure", 0, "revision is out of range"), ("k", "paid_failure", None, "revision is no number")]
    df = spark.createDataFrame(snaps, "k string, c string, r long, want string")
    assert all(r.e == r.want for r in df.select("want", R.hold_snapshot(F.col("k"), F.col("c"), F.col("r")).alias("e")).collect())
    names = ("model", "instructions", "input_text", "effort", "schema_name", "schema", "tokens", "key")
    good = dict(zip(names, ("m", "i", "t", "low", "s_1", "{}", 5, "ar-1:x.y")))
    cases = [({}, None), ({"model": " "}, "model is empty"), ({"instructions": "a\0"}, "instructions has a NUL"), ({"schema": "[]"}, "json_schema is no object"), ({"schema": None}, "json_schema is no object"), ({"tokens": 0}, "max_output_tokens is out of range"), ({"key": "a b"}, "idempotency_key is not allowed"), ({"key": "x" * 201}, "idempotency_key is not allowed"), ({"schema_name": "a.b"}, "schema_name is not allowed"), ({"schema_name": "x" * 65}, "schema_name is not allowed"), ({"effort": "very low"}, "reasoning_effort is not allowed")]
    df = spark.createDataFrame([tuple((good | c).values()) + (w,) for c, w in cases], ", ".join(f"{n} {'int' if n == 'tokens' else 'string'}" for n in names) + ", want string")
    got = df.select("want", R.provider_request(*[F.col(n) for n in names]).alias("e")).collect()
    assert [r.e for r in got] == [w for _, w in cases]


def test_next_steps(spark):
    cases = []  # holds, state, force, retry, current -> step
    for state, plain, force, retry in ((None, "enqueue", "enqueue", "enqueue"), ("queued", "run", "run", "run"), ("budget_blocked", "run", "run", "run"), ("cancelled", "requeue", "requeue", "requeue"), ("unknown", "refused", "requeue", "refused"), ("permanent_failed", "refused", "requeue", "requeue"), ("succeeded", "refused", "refused", "refused")):
        cases += [((), state, False, False, False, plain), (("fallback_pending",), state, False, False, False, plain), (("paid_failure",), state, False, False, False, "held_paid"), (("paid_failure",), state, False, True, False, retry), (("paid_failure", "fallback_pending"), state, False, True, False, retry), (("ambiguous",), state, False, True, False, "held_ambiguous"), (("ambiguous", "paid_failure"), state, True, False, False, force), (("ambiguous",), state, False, False, True, "cached"), ((), state, None, None, False, plain)]
    requests = spark.createDataFrame([(i, c[2], c[3]) for i, c in enumerate(cases)], "k int, force boolean, retry_paid boolean")
    holds = spark.createDataFrame([(i, h) for i, c in enumerate(cases) for h in c[0]], "k int, hold_class string")
    jobs = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases) if c[1]], "k int, state string")
    current = spark.createDataFrame([(i,) for i, c in enumerate(cases) if c[4]], "k int")
    got = {r.k: r.step for r in workflow.next_steps(requests, current, holds, jobs, "k").collect()}
    assert [(c, got[i]) for i, c in enumerate(cases)] == [(c, c[5]) for c in cases]


def test_queue_operations(spark):
    jobs = spark.createDataFrame([("a", "c1"), ("b", None)], "k string, c string")
    given = spark.createDataFrame([("a", "c1"), ("a", "c9"), ("b", "c1"), ("new", "c2"), ("new", "c3"), ("other", "c2"), ("last", None), ("last", None)], "k string, c string")
    got = sorted((r.k, r.c or "", r.outcome) for r in workflow.enqueue(jobs, given, "k", "c").collect())
    assert got == [("a", "c1", "present"), ("a", "c9", "present"), ("b", "c1", "rebound"), ("last", "", "queued"), ("last", "", "queued"), ("new", "c2", "queued"), ("new", "c3", "present"), ("other", "c2", "rebound")]
    state = spark.createDataFrame([(i, s, 3, 3, "t0") for i, s in enumerate(("cancelled", "permanent_failed", "unknown", "queued", "cancelled"))], "i int, state string, attempts int, max_attempts int, updated_at string")
    out = {r.i: (r.state, r.max_attempts, r.updated_at, r.changed) for r in workflow.retry_jobs(state, spark.createDataFrame([(i,) for i in range(4)], "i int"), "i", F.lit("t1")).collect()}
    assert out == {0: ("queued", 4, "t1", True), 1: ("queued", 4, "t1", True), 2: ("unknown", 3, "t0", False), 3: ("queued", 3, "t0", False), 4: ("cancelled", 3, "t0", False)}
    again = workflow.retry_jobs(state, spark.createDataFrame([(2,), (2,)], "i int"), "i", F.lit("t1"), allow_unknown=True)
    assert {r.i: r.state for r in again.collect()}[2] == "queued" and again.count() == 5


def result(item, tasks, task="summary", given=None, **change):
    out = {"item": item, "base": str(item), "asked": tasks, "article_id": item, "content_hash": "h", "task": task, "output": given or json.dumps({"summary": "s", "key_points": ["k"], "language": "en", "basis": "metadata", "limitations": ""})}
    return tuple((out | change).values())


def test_results_are_imported_whole_or_not_at_all(spark):
    names = ["summary", "translation"]
    frame = lambda rows: spark.createDataFrame(rows, "item long, base string, asked array<string>, article_id long, content_hash string, task string, output string").withColumn("fingerprint", subsets.set_fingerprint(F.col("base"), F.col("asked"))).drop("asked")
    articles = spark.createDataFrame([(i, "h") for i in range(1, 9)], "id long, content_hash string")
    stored = spark.createDataFrame([(2, "summary", "h"), (2, "summary", "h"), (1, "summary", "older")], "article_id long, task string, content_hash string")
    good = [result(1, names), result(2, ["summary"])]
    run = lambda rows: [(r["item"], r.outcome, r.readable) for r in workflow.import_results(frame(rows), articles, stored, names, "en").orderBy("item", "outcome").collect()]
    assert run(good) == [(1, "stored", "s\n• k"), (2, "present", "s\n• k")]
    bad = [result(3, ["else"]), result(4, ["translation"]), result(5, names), result(5, names), result(6, names, content_hash="x"), result(99, names), result(7, names, given="{}")]
    want = [(1, "refused", "s\n• k"), (2, "present", "s\n• k"), (3, "unknown_request", None), (4, "not_asked", None), (5, "repeated", None), (5, "repeated", None), (6, "stale", None), (7, "broken", None), (99, "stale", None)]
    assert run(good + bad) == want
    assert run([]) == []


def test_first_known_and_pending(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (1,), (None,)], "k int")
    tables = [spark.createDataFrame(x, "k int, v string") for x in ([(1, None)], [(1, "b"), (2, "b")])]
    assert sorted(map(tuple, workflow.first_known(rows, "k", tables, ["v"]).collect()), key=repr) == sorted([(1, None, 0), (2, "b", 1), (3, None, None), (1, None, 0), (None, None, None)], key=repr)
    got = workflow.pending_counts(spark.createDataFrame([(1,), (2,)], "k int"), rows, "k").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1)]
