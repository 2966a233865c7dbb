"""Running values, intervals and ordered decisions against plain loops."""

import random
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomfeed.operators import intervals, joins
from loomfeed.operators.admission import Limits, admit
from loomfeed.operators.scan import running

RNG = random.Random(7)


@pytest.mark.parametrize("before", [False, True])
def test_running_values_split_a_large_key(spark, before):
    rows = [("a", i, RNG.randrange(-5, 20) if RNG.random() < 0.9 else None) for i in range(1500)] + [("b", i, i) for i in range(7)] + [(None, i, 1) for i in range(3)]
    df = spark.createDataFrame(RNG.sample(rows, len(rows)), "k string, i int, v int").repartition(4)
    values = {"total": ("sum", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v")), "n": ("count", None), "last": ("last", F.struct("v"))}
    out = running(df, ["k"], [F.col("i")], values, ranges=6, before=before)
    # one key is dealt out to several ranges and no task sorts all of it
    assert "Window" in out._jdf.queryExecution().toString()
    got = {(r.k, r.i): (r.total, r.most, r.least, r.n, r["last"].v if r["last"] else None) for r in out.collect()}
    for k in ("a", "b", None):
        mine = sorted((i, v) for x, i, v in rows if x == k)
        for at, (i, _) in enumerate(mine):
            seen = [v for _, v in mine[: at + (not before)]]
            have = [v for v in seen if v is not None]
            want = (sum(have) if have else None, max(have, default=None), min(have, default=None), len(seen) or None, mine[at - 1][1] if at else None)
            assert got[k, i] == want, (k, i)


def test_running_without_keys_uses_many_ranges(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    out = running(df, [], [F.desc("id")], {"total": ("sum", F.col("v"))}, ranges=5)
    total, want = 0, {}
    for i in range(4999, -1, -1):
        total += i % 7
        want[i] = total
    assert {r.id: r.total for r in out.collect()} == want
    assert running(df.limit(0), [], [F.col("id")], {"total": ("sum", F.col("v"))}).count() == 0


def spans(n, most):
    out = []
    for i in range(n):
        a = RNG.randrange(-200, 1000)
        out.append((i, RNG.choice("xy"), a, a + RNG.choice([0, -3, 1, 2, 5, 17, 130, most])))
    return [*out, (n, None, 1, 5), (n + 1, "x", None, 5), (n + 2, "x", 3, None)]


def test_overlap_join_equals_all_pairs(spark):
    a, b = spans(120, 900), spans(90, 40)
    schema = "id int, k string, s long, e long"
    for keys in (["k"], []):
        got = sorted((r.id, r.id_r) for r in intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "s", "e", keys).collect())
        live = lambda x: x[2] is not None and x[3] is not None and x[3] > x[2] and (x[1] is not None or not keys)
        want = sorted((x[0], y[0]) for x in a for y in b if live(x) and live(y) and (not keys or x[1] == y[1]) and max(x[2], y[2]) < min(x[3], y[3]))
        assert got == want and len(got) > 300


def test_merged_intervals(spark):
    rows = [x for x in spans(80, 50) if x[2] is not None and x[3] is not None]
    got = {(r.k, r.s, r.e) for r in intervals.merged(spark.createDataFrame(rows, "id int, k string, s long, e long"), "s", "e", ["k"]).collect()}
    want = set()
    for k in ("x", "y", None):
        run = None
        for s, e in sorted((x[2], x[3]) for x in rows if x[1] == k and x[3] > x[2]):
            if run and s <= run[1]:
                run[1] = max(run[1], e)
            else:
                if run:
                    want.add((k, *run))
                run = [s, e]
        if run:
            want.add((k, *run))
    assert got == want


@pytest.mark.parametrize("through", [None, "t"])
def test_points_that_no_interval_holds(spark, through):
    held = [(k, s, e, s + RNG.randrange(-4, 60) if s is not None else None) for _, k, s, e in spans(60, 60)]
    points = [(i, RNG.choice(["x", "y", None]), RNG.randrange(-250, 1100)) for i in range(400)] + [(401, "x", None)]
    df = intervals.not_inside(spark.createDataFrame(points, "id int, k string, at long"), spark.createDataFrame(held, "k string, s long, e long, t long"), "at", "s", "e", through, ["k"])
    got = sorted(r.id for r in df.collect())
    inside = lambda k, at: at is not None and any(k == c and s is not None and e is not None and s <= at < e and (through is None or t is not None and at <= t) for c, s, e, t in held)
    assert got == sorted(i for i, k, at in points if not inside(k, at)) and 20 < len(got) < 390


def test_overlaps_without_a_grouping(spark):
    rows = [(0, 5), (5, 9), (8, 12), (11, 20), (20, 21)]
    got = joins.overlaps(spark.createDataFrame(rows, "s int, e int"), "s", "e").collect()
    assert sorted((r.s, r.previous_end) for r in got) == [(8, 9), (11, 12)]


LA = ZoneInfo("America/Los_Angeles")
LIMITS = Limits(daily_requests=4, daily_tokens=100, monthly_requests=30, monthly_tokens=900, daily_cost=60, monthly_cost=400)


def admitted(requests, settlements, carried, limits, most):
    """Decisions by the plain rules, one request after another."""
    day_of = lambda t: t.replace(tzinfo=UTC).astimezone(LA).date()
    used = [(s, d, n, t, c) for s, d, n, t, c in carried]
    actual = {i: (at, t, c) for i, at, t, c in settlements}
    open_, tries, ended, out = {}, {}, set(), {}
    events = sorted([(r[3], 0, r[1], r) for r in requests] + [(at, 1, i, None) for i, at, _, _ in settlements], key=lambda e: e[:3])
    for at, kind, i, r in events:
        if kind:
            if i in open_ and at >= open_[i][5]:
                s, d, n, _, _, t0 = open_[i]
                open_[i] = (s, d, n, actual[i][1], actual[i][2], t0)
            continue
        s, _, job, ts, tokens, cost, cached = r
        day = day_of(ts)
        rows = [x for x in used if x[0] == s] + [x[:5] for x in open_.values() if x[0] == s]
        of_day = [sum(x[k] for x in rows if x[1] == day) for k in (2, 3, 4)]
        of_month = [sum(x[k] for x in rows if (x[1].year, x[1].month) == (day.year, day.month)) for k in (2, 3, 4)]
        if cached:
            out[i] = ("cached", None, None)
        elif (s, job) in ended:
            out[i] = ("conflict", "ended", None)
        elif tries.get((s, job), 0) >= most:
            ended.add((s, job))
            out[i] = ("attempt_limit", "attempts", None)
        else:
            never, later = [], []
            for name, have, asked, limit, strict in (("daily_requests", of_day[0], 1, limits.daily_requests, 1), ("daily_tokens", of_day[1], tokens, limits.daily_tokens, 1), ("monthly_requests", of_month[0], 1, limits.monthly_requests, 1), ("monthly_tokens", of_month[1], tokens, limits.monthly_tokens, 1), ("daily_cost", of_day[2], cost, limits.daily_cost, 0), ("monthly_cost", of_month[2], cost, limits.monthly_cost, 0)):
                if not strict and limit <= 0:
                    continue
                if limit <= 0 or not name.endswith("requests") and asked > limit:
                    never.append(name)
                elif have + asked > limit:
                    later.append(name)
            if never:
                ended.add((s, job))
                out[i] = ("impossible", never[0], None)
            elif later:
                ends = [datetime(*(day + timedelta(1)).timetuple()[:3], tzinfo=LA) if x.startswith("daily") else datetime(day.year + day.month // 12, day.month % 12 + 1, 1, tzinfo=LA) for x in later]
                out[i] = ("blocked", later[0], max(x.astimezone(UTC).replace(tzinfo=None) for x in ends))
            else:
                tries[s, job] = tries.get((s, job), 0) + 1
                open_[i] = (s, day, 1, tokens, cost, ts)
                out[i] = ("admitted", None, None)
    return out


def test_admission_in_order_equals_a_plain_loop(spark):
    base = datetime(2024, 2, 20)
    requests, settlements = [], []
    for i in range(900):
        scope = "hot" if i % 3 else f"s{i % 5}"
        ts = base + timedelta(minutes=RNG.randrange(60 * 24 * 45) // 30 * 30)
        requests.append((scope, i, f"j{RNG.randrange(40)}" if i % 50 else "many", ts, RNG.choice([5, 10, 30, 60, 101, 0]) if RNG.random() < 0.98 else 1000, RNG.choice([0, 1, 15, 30]), RNG.random() < 0.05))
        if RNG.random() < 0.5:
            settlements.append((i, ts + timedelta(minutes=RNG.choice([-30, 0, 30, 600, 60 * 24 * 3])), RNG.randrange(40), RNG.randrange(20)))
    carried = [("hot", date(2024, 2, 25), 2, 40, 3), ("hot", date(2024, 3, 3), 1, 99, 0), ("s0", date(2024, 3, 1), 4, 0, 0), ("none", date(2024, 3, 1), 4, 0, 0)]
    want = admitted(requests, settlements, carried, LIMITS, 3)
    df = spark.createDataFrame(requests, "scope string, id long, job string, ts timestamp, tokens long, cost long, cached boolean").repartition(3)
    out = admit(df, LIMITS, spark.createDataFrame(settlements, "id long, at timestamp, tokens long, cost long"), spark.createDataFrame(carried, "scope string, day date, requests long, tokens long, cost long"))
    got = {r.id: (r.decision, r.reason, r.next_attempt) for r in out.withColumn("next_attempt", F.to_timestamp_ntz("next_attempt")).collect()}
    assert got == want
    assert {d for d, _, _ in want.values()} == {"cached", "conflict", "attempt_limit", "impossible", "blocked", "admitted"}


def test_admission_of_empty_tables_and_zero_limits(spark):
    df = spark.createDataFrame([("s", 1, "j", datetime(2024, 1, 1), None, None, None), (None, 2, None, datetime(2024, 1, 1), 1, 1, False)], "scope string, id long, job string, ts timestamp, tokens long, cost long, cached boolean")
    assert admit(df.limit(0), LIMITS).count() == 0
    assert {r.id: r.reason for r in admit(df, Limits(0, 10, 1, 10)).collect()} == {1: "daily_requests", 2: "daily_requests"}
    assert {(r.scope, r.decision, r.attempt) for r in admit(df, LIMITS).collect()} == {("s", "admitted", 1), ("", "admitted", 1)}
