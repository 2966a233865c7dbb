"""Canonical values, trees of digests, named sets and spaced requests against plain forms."""

import hashlib
import json
import random
from datetime import UTC, datetime, timedelta
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfeed.functions import json_values as J
from loomfeed.operators import merkle, spacing, subsets

RNG = random.Random(5)
GOOD = ['{"b": 1, "a": {"d": [3, {"z": 0, "y": null}], "c": true}}', "[]", "{}", '"text"', "3", "-0.0", "1.50", "12345678901234567890123", '{"é": "\\u00e9\\n", "a/b": "\\/"}', '{"id": {"id": 1}, "x": [{"id": 2}]}', "null", '{"😀": 1, "￿": 2}', "[" * 199 + "]" * 199]
BAD = ['{"a": 1, "a": 2}', '{"x": {"a": 1, "a": 1}}', "NaN", "[Infinity]", "{'a': 1}", "", "1 2", '"\\ud800"', "{", "[" * 400 + "]" * 400, "1e999"]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*GOOD, *BAD, None])], "i int, t string")


def plain(value):
    """Canonical JSON by its rules, written out."""
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + plain(value[k]) for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def test_canonical_text_and_digest(values):
    got = {r.i: r for r in values.select("i", J.canonical_text(F.col("t")).alias("c"), J.value_digest(F.col("t")).alias("d"), J.without_own_hash(F.col("t"), "b").alias("w"), J.members(F.col("t")).alias("m")).collect()}
    for i, t in enumerate(GOOD):
        v = json.loads(t)
        assert got[i].c == plain(v), t
        assert got[i].d == hashlib.sha256((v if isinstance(v, str) else plain(v)).encode()).hexdigest()
        assert (got[i].w is not None) == isinstance(v, dict)
    assert got[0].w == hashlib.sha256(b'{"a":{"c":true,"d":[3,{"y":null,"z":0}]}}').hexdigest() and got[0].m == "a,b,c,d,y,z"
    assert all(got[i].c is None and got[i].d is None and got[i].m is None for i in range(len(GOOD), len(GOOD) + len(BAD) + 1))


def test_members_are_replaced_at_any_depth(values):
    got = {r.i: r.c for r in values.select("i", J.replaced(F.col("t"), "id", F.lit('{"p": [2, 1]}')).alias("c")).collect()}
    assert got[9] == '{"id":{"p":[2,1]},"x":[{"id":{"p":[2,1]}}]}' and got[1] == "[]" and got[len(GOOD)] is None
    assert values.where("i = 9").select(J.replaced(F.col("t"), "id", F.lit("{")).alias("c")).first().c is None


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(codec="utf-8"), max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=3), x, max_size=4), max_leaves=20))
def test_canonical_is_independent_of_order_and_spaces(value):
    text = J.canonical(value)
    assert text == plain(value) and J.canonical(J.parse_strict(json.dumps(value, indent=1))[0]) == text == J.canonical(J.parse_strict(text)[0])


def test_one_changed_row_is_located(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 else float(i)) for i in range(3000)]
    a = spark.createDataFrame(rows, "k long, s string, x double")
    b = a.withColumn("s", F.when(F.col("k") == 1234, "other").otherwise(F.col("s"))).repartition(3)
    trees = [merkle.digest_tree(t, ["k"], 8, 3).collect() for t in (a, b)]
    assert len(trees[0]) == len(trees[1]) > 500
    differ = {(r.level, r.node) for r in set(trees[0]) - set(trees[1])}
    assert len(differ) == 4 and {level for level, _ in differ} == {0, 1, 2, 3}
    leaf = merkle.differing_leaves(*(merkle.digest_tree(t, ["k"], 8, 3) for t in (a, b)), 8, 3).collect()
    assert [(3, r.node) for r in leaf] == [x for x in differ if x[0] == 3]
    assert [tuple(r) for r in merkle.changes(a, b, ["k"], 8, 3).collect()] == [(1234, "changed")]
    assert merkle.changes(a, a.repartition(5), ["k"]).count() == 0
    assert [(r.level, r.n_rows) for r in merkle.digest_tree(a, ["k"], 8, 3).where("level = 0").collect()] == [(0, 3000)]


def test_trees_of_repeated_rows_and_empty_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, s string")
    twice = a.unionByName(a.where("k = 1"))
    root = lambda t: t.where("level = 0").collect()
    assert root(merkle.digest_tree(a, ["k"]))[0].digest != root(merkle.digest_tree(twice, ["k"]))[0].digest
    assert merkle.digest_tree(a.limit(0), ["k"]).count() == 0
    assert {tuple(r) for r in merkle.changes(a.limit(0), a, ["k"]).collect()} == {(1, "added"), (2, "added")}
    assert {tuple(r) for r in merkle.changes(a, a.where("k = 2"), ["k"]).collect()} == {(1, "removed")}


def test_every_set_is_named_by_its_fingerprint(spark):
    names = ["d", "a", "c", "b"]
    rows = [(base, list(s)) for base in (None, "x", "") for k in range(5) for s in combinations(names, k)] + [("x", ["a", "d"]), ("x", ["zz"])]
    df = spark.createDataFrame(rows, "base string, s array<string>").withColumn("f", subsets.set_fingerprint(F.coalesce("base", F.lit("?")), F.col("s")))
    got = df.select("base", "s", subsets.named_set(F.col("base"), F.col("f"), names).alias("g")).collect()
    for r in got:
        known = r.base is not None and r.s and tuple(r.s) in {c for k in range(1, 5) for c in combinations(names, k)}
        assert r.g == (r.s if known else None), r
    table = subsets.set_table(spark, names, "x")
    assert table.count() == 15 and table.join(df.where("base = 'x'"), table["fingerprint"] == df["f"]).count() == 15
    for bad in (["a", "a"], list("abcdefghijk")):
        with pytest.raises(ValueError):
            subsets.set_table(spark, bad)


def test_spaced_requests_equal_a_plain_loop(spark):
    rows = [(i, "hot" if i % 3 else f"h{i % 4}", RNG.randrange(2000) if i % 20 else None) for i in range(500)]
    out = spacing.spaced(spark.createDataFrame(rows, "i int, host string, at long"), "host", "at", "i", F.when(F.col("host") == "hot", 7).otherwise(11)).collect()
    last, want = {}, {i: None for i, _, _ in rows}
    for at, i, h in sorted((at, i, h) for i, h, at in rows if at is not None):
        gap = 7 if h == "hot" else 11
        last[h] = want[i] = max(at, last.get(h, -(10**9)) + gap)
    assert {r.i: r.start for r in out} == want


def test_retry_after_headers(spark):
    now = datetime(2024, 3, 1, 12, 0, 0)
    http = lambda s: (now + timedelta(seconds=s)).strftime("%a, %d %b %Y %H:%M:%S GMT")
    cases = [("5", 5.0), (" 2.5 ", 2.5), ("-3", 0.0), (http(90), 90.0), (http(-90), 0.0), ("nan", 4.125), ("inf", 4.125), ("later", 4.125), ("", 4.125), (None, 4.125), ("1e400", 4.125)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    got = df.select("i", spacing.retry_after(F.col("h"), F.lit(now.replace(tzinfo=UTC)).cast("timestamp"), F.lit(2.0), F.lit(0.5)).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: w for i, (_, w) in enumerate(cases)}
