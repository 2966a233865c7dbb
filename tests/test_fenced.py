"""Streams in several batches equal their batch forms; writers of one table compete."""

import random
import threading
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomfeed.operators import usage
from loomfeed.operators.scan import running
from loomfeed.sources.versions import Conflict, Refused, Version, VersionedTable, committed_stream, fenced_update
from loomfeed.streaming import leases, state
from loomfeed.streaming import usage as usage_stream

RNG = random.Random(13)
ATTEMPT = "id long, started timestamp, reservation_active int, reserved_total long, reserved_cost long, actual_input long, actual_cached long, actual_cache_write long, actual_output long, actual_reasoning long, actual_total long, actual_cost long"


def attempt(i, at):
    held = i % 5 == 0
    used = [None] * 7 if held or i % 7 == 0 else [i % 50, i % 20, i % 3, i % 30, i % 9, i % 80, i % 11]
    return (i, at, int(held), i % 90 if held else 0, i % 8 if held else 0, *used)


def source(spark, path, batches, schema):
    """A stream whose batches are these lists of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_daily_usage_of_late_and_repeated_rows(spark, tmp_path):
    base = datetime(2024, 3, 1)  # the clocks change on the 10th
    rows = [attempt(i, base + timedelta(minutes=RNG.randrange(60 * 24 * 20))) for i in range(600)]
    rows.sort(key=lambda r: r[1])
    late = [r for r in rows if r[0] % 10 == 3]
    first = [r for r in rows if r not in late]
    repeats = RNG.sample(rows, 40)
    batches = [first[:250], first[250:], [*late, *repeats]]
    ledger = spark.createDataFrame([(date(2024, 3, 5), datetime(2024, 3, 5, 20), 7, 70), (date(2024, 3, 10), datetime(2024, 3, 11, 3), 1, 3)], "day date, covered_through timestamp, requests long, total long")
    changes = state.drained(usage_stream.daily_usage(source(spark, str(tmp_path / "in"), batches, ATTEMPT), ledger), "usage", "update")
    got = usage_stream.settled_days(changes, ledger)
    want = usage.daily_rollup(spark.createDataFrame(rows, ATTEMPT), ledger, keep_days=62)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert changes.select("batch").distinct().count() >= 3


def test_state_of_days_past_the_retention_is_gone(spark, tmp_path):
    base = datetime(2024, 1, 2, 12)
    batches = [[attempt(100 * k + i, base + timedelta(days=25 * k, minutes=i)) for i in range(5)] for k in range(6)]
    batches.append([attempt(9999, base + timedelta(days=125)), attempt(9998, base)])  # the second is too late
    stream = usage_stream.daily_usage(source(spark, str(tmp_path / "in"), batches, ATTEMPT), keep_days=30)
    q = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [{o["operatorName"]: o["numRowsTotal"] for o in p["stateOperators"]} for p in map(lambda p: __import__("json").loads(p.json), q.recentProgress) if p["stateOperators"]]
    assert max(h["stateStoreSave"] for h in held) <= 3 and held[-1]["stateStoreSave"] <= 2
    assert held[-1]["dedupeWithinWatermark"] <= 16  # of 31 ids; they go after twice the days
    days = state.drained(usage_stream.daily_usage(source(spark, str(tmp_path / "again"), batches, ATTEMPT), keep_days=30), "usage", "update")
    assert {r.day: r.requests for r in state.latest(days, "day").collect()}[civil(base)] == 5


def civil(at):
    from zoneinfo import ZoneInfo

    return at.replace(tzinfo=UTC).astimezone(ZoneInfo("America/Los_Angeles")).date()


EVENT = "job long, id long, at timestamp, kind string"


@pytest.mark.parametrize("cuts", [(), (150, 151, 400)])
def test_leases_in_several_batches(spark, tmp_path, cuts):
    base = datetime(2024, 5, 1)
    kinds = [*leases.KINDS, "lease", "lease", "noise"]
    rows = [(RNG.randrange(25), i, base + timedelta(seconds=7 * i + RNG.randrange(7)), RNG.choice(kinds)) for i in range(600)]
    bounds = [0, *cuts, len(rows)]
    batches = [rows[a:b] for a, b in zip(bounds, bounds[1:])]
    out = state.drained(leases.lease_changes(source(spark, str(tmp_path / "in"), batches, EVENT), "job", seconds=120, max_attempts=2), "leases")
    end = int(rows[-1][2].replace(tzinfo=UTC).timestamp())
    want = leases.lease_changes_batch(spark.createDataFrame(rows, EVENT), "job", end, seconds=120, max_attempts=2)
    got = sorted(map(tuple, out.drop("batch").collect()))
    assert got == sorted(map(tuple, want.collect()))
    reasons = {r[4] for r in got}
    assert reasons == {"enqueue", "lease", "complete", "fail", "lease_expired"}


def test_a_timer_ends_a_lease_without_an_event_of_its_job(spark, tmp_path):
    at = lambda s: datetime(2024, 5, 1) + timedelta(seconds=s)
    batches = [[(1, 0, at(0), "enqueue"), (1, 1, at(1), "lease")], [(2, 2, at(500), "enqueue")]]
    out = state.drained(leases.lease_changes(source(spark, str(tmp_path / "in"), batches, EVENT), "job", seconds=300), "leases").collect()
    start = int(at(0).replace(tzinfo=UTC).timestamp())
    assert (1, start + 301, "retryable", 1, "lease_expired") in {(r.job, r.at, r.state, r.attempts, r.reason) for r in out}
    none = leases.lease_changes_batch(spark.createDataFrame([], EVENT), "job", 0)
    assert none.count() == 0


def test_claims_get_jobs_in_order(spark):
    now = datetime(2024, 5, 1)
    jobs = [(i, RNG.choice(["queued", "retryable", "budget_blocked", "leased"]), RNG.randrange(3), 2, RNG.choice([None, now, now + timedelta(1)]), RNG.randrange(3), now - timedelta(hours=RNG.randrange(5))) for i in range(80)]
    claims = [(f"w{i:03d}", now + timedelta(seconds=RNG.randrange(9))) for i in range(60)]
    first = min(t for _, t in claims)
    queue = sorted((p, c, i) for i, s, a, m, due, p, c in jobs if s != "leased" and a < m and (due is None or due <= first))
    got = {r.id: r.job_id for r in leases.assign(spark.createDataFrame(jobs, "id int, state string, attempts int, max_attempts int, due timestamp, priority int, created timestamp"), spark.createDataFrame(claims, "id string, at timestamp")).collect()}
    for n, (_, w) in enumerate(sorted((t, w) for w, t in claims)):
        assert got[w] == (queue[n][2] if n < len(queue) else None)


@pytest.fixture
def kept(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"), "k long, v long, rev long")


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k long, v long, rev long")


def test_of_two_writers_one_wins(spark, kept):
    assert kept.read().count() == 0 and kept.version() == Version(0)
    seen, won, lost = kept.version(), [], []
    gate = threading.Barrier(4)

    def write(i):
        own = VersionedTable(spark, kept.path, kept.schema)
        gate.wait()
        try:
            won.append((i, own.commit(rows(spark, (i, i, i)), seen).number))
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3 and won[0][1] == 1
    assert [r.k for r in kept.read().collect()] == [won[0][0]]
    # after a conflict a writer goes on from what is there
    kept.change(lambda c: c.unionByName(rows(spark, (9, 9, 9))))
    assert {r.k for r in kept.read().collect()} == {won[0][0], 9} and kept.version().number == 2
    assert [r.k for r in kept.read(1).collect()] == [won[0][0]]


def test_a_repeated_batch_changes_nothing(spark, kept):
    add = lambda c: c.unionByName(rows(spark, (1, 1, 1)))
    a = kept.change(add, batch=("w", 3))
    assert kept.change(add, batch=("w", 3)) == a and kept.change(add, batch=("w", 2)) == a and kept.read().count() == 1
    assert kept.change(add, batch=("other", 3)).number == 2 and kept.read().count() == 2
    b = kept.commit(rows(spark, (2, 2, 2)), kept.version(), append=True)
    assert kept.read().count() == 3 and len(b.folders) == 2
    with pytest.raises(Refused):
        kept.change(lambda c: c, checks=lambda c: "no good")
    assert kept.version() == b


def test_revisions_fence_updates(spark, kept):
    kept.change(lambda _: rows(spark, *((i, 10 * i, i) for i in range(1, 6))))
    ask = lambda *r: spark.createDataFrame(list(r), "k long, rev long")
    with pytest.raises(Refused):
        fenced_update(kept, ask((1, 1), (2, 9)), "k", "rev", {"v": F.col("v") + 1})
    with pytest.raises(Refused):
        fenced_update(kept, ask((7, 1)), "k", "rev", {"v": F.col("v") + 1})
    with pytest.raises(Refused):
        fenced_update(kept, ask((1, 1)), "k", "rev", {"v": F.col("v") + 1}, fence=4)
    v, n = fenced_update(kept, ask((4, 4), (2, 2)), "k", "rev", {"v": F.col("v") + 1}, fence=5, batch=("s", 1))
    want = {1: (10, 1), 2: (21, 6), 3: (30, 3), 4: (41, 7), 5: (50, 5)}
    assert n == 2 and {r.k: (r.v, r.rev) for r in kept.read().collect()} == want
    assert fenced_update(kept, ask((4, 4), (2, 2)), "k", "rev", {"v": F.col("v") + 1}, fence=5, batch=("s", 1)) == (v, 0)
    with pytest.raises(Refused):
        fenced_update(kept, ask((3, 3)), "k", "rev", {"v": F.col("v")}, fence=5)
    assert {r.k: (r.v, r.rev) for r in kept.read().collect()} == want


def test_a_stream_commits_each_batch_once(spark, kept, tmp_path):
    batches = [[(i % 3, i, 1) for i in range(10 * k, 10 * k + 10)] for k in range(3)]
    add = lambda c, r: c.unionByName(r).groupBy("k").agg(F.sum("v").alias("v"), F.sum("rev").alias("rev"))
    for again in range(2):  # the second time as after the loss of its checkpoint
        committed_stream(source(spark, str(tmp_path / f"in{again}"), batches, "k long, v long, rev long"), kept, "stream", str(tmp_path / f"cp{again}"), add)
        assert kept.version().number == 3
        assert {r.k: (r.v, r.rev) for r in kept.read().collect()} == {k: (sum(i for i in range(30) if i % 3 == k), 10) for k in range(3)}
    assert running(kept.read(), [], [F.col("k")], {"n": ("count", None)}).count() == 3
