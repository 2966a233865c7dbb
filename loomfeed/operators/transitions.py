"""State changes that must be checked before they are made: identities, snapshots, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.artifacts import settled_by_success
from .scan import running


def mark_seen(seen: DataFrame, pending: DataFrame, entries: DataFrame, keys: list[str], stamp: str, position: str) -> tuple[DataFrame, DataFrame]:
    """(seen, pending) after entries were handled in the order of position: the last entry of a key gives its stamp, an empty one too (null counts as empty); handled keys are no longer pending."""
    new = entries.groupBy(*keys).agg(F.max_by(F.struct(F.coalesce(stamp, F.lit("")).alias("stamp")), position).alias("_new"))
    out = seen.join(new, keys, "full_outer").select(*keys, F.coalesce("_new.stamp", stamp).alias(stamp))
    return out, pending.join(new.select(*keys), keys, "left_anti")


def record_checks(state: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Checks after their runs (key, at, outcome, error): the last run counts; a failure adds to the streak, any other outcome ends it. Keys without a state begin one with no failures; times of a key differ."""
    last = runs.groupBy(key).agg(F.max_by(F.struct("at", "outcome", "error"), "at").alias("l"), F.max(F.when(F.col("outcome") != "failure", F.col("at"))).alias("ok"))
    after = runs.join(last.select(key, "ok"), key).groupBy(key).agg(F.count_if((F.col("outcome") == "failure") & (F.col("ok").isNull() | (F.col("at") > F.col("ok")))).alias("n"))
    j = state.join(last, key, "full_outer").join(after, key, "left")
    before = F.coalesce("failures", F.lit(0))
    failures = F.when(F.col("l").isNull(), before).otherwise(F.col("n") + F.when(F.col("ok").isNull(), before).otherwise(0))
    return j.select(key, F.coalesce("l.at", "checked_at").alias("checked_at"), F.coalesce("ok", "ok_at").alias("ok_at"), failures.cast("long").alias("failures"), F.when(F.col("l").isNull(), F.col("error")).otherwise(F.when(F.col("l.outcome") == "failure", F.col("l.error"))).alias("error"))


def sync_configs(stored: DataFrame, configured: DataFrame, key: str, identity: list[str], fields: list[str], fetch: str, validators: list[str], initialized: str) -> DataFrame:
    """Stored sources under a new configuration, with change: inserted, updated, kept, absent, or conflict and refused.

    The identity, of which `fetch` is a part, of a source that is initialized (its column not
    null or empty) must stay; one that would change is a conflict, and then nothing is changed
    at all: new sources are left out and changes to others are refused. Validators are
    dropped where the fetch column changes.
    """
    cols = [*identity, *fields]
    n = configured.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_in"))
    j = stored.withColumn("_had", F.lit(True)).join(n, key, "full_outer")
    same = lambda names: F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]), lambda x: x)
    fixed = F.coalesce(F.col(initialized).cast("string"), F.lit("")) != ""
    change = F.when(F.col("_in").isNull(), "absent").when(F.col("_had").isNull(), "inserted").when(fixed & ~same(identity), "conflict").when(same(cols), "kept").otherwise("updated")
    j = j.withColumn("change", change)
    clash = j.agg(F.coalesce(F.bool_or(F.col("change") == "conflict"), F.lit(False)).alias("_clash"))
    j = j.join(F.broadcast(clash)).where(~(F.col("_clash") & (F.col("change") == "inserted")))  # one row
    j = j.withColumn("change", F.when(F.col("_clash") & (F.col("change") == "updated"), "refused").otherwise(F.col("change")))
    put = F.col("change").isin("inserted", "updated")
    moved = put & ~F.col(fetch).eqNullSafe(F.col(f"_{fetch}"))
    return j.select(key, *[F.when(put, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols], *[F.when(~moved, F.col(v)).alias(v) for v in validators], initialized, "change")


def upsert_outputs(stored: DataFrame, given: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keyed outputs with change: a row is written only if one of its fields (hash or output) differs."""
    n = given.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_in"))
    j = stored.withColumn("_had", F.lit(True)).join(n, keys, "full_outer")
    same = F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields]), lambda x: x)
    change = F.when(F.col("_in").isNull(), "kept").when(F.col("_had").isNull(), "inserted").when(same, "kept").otherwise("updated")
    j = j.withColumn("change", change)
    return j.select(*keys, *[F.when(F.col("change") == "kept", F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in fields], "change")


def compare_and_set(state: DataFrame, requests: DataFrame, key: str, expected: list[str], changes: dict[str, Column]) -> DataFrame:
    """state with the changes made in rows that still are as a request (key, expected columns) saw them; changed tells which."""
    r = requests.select(key, *[F.col(c).alias(f"_{c}") for c in expected], F.lit(True).alias("_asked")).dropDuplicates([key])
    j = state.join(r, key, "left")
    hit = F.coalesce(F.col("_asked") & F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in expected]), lambda x: x), F.lit(False))
    j = j.withColumn("changed", hit)
    return j.select(*[F.when(F.col("changed"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in state.columns], "changed")


def clear_if(state: DataFrame, requests: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """state without the rows that still are as a request saw them."""
    return compare_and_set(state, requests, key, expected, {}).where(~F.col("changed")).drop("changed")


def store_artifacts(artifacts: DataFrame, given: DataFrame, articles: DataFrame, keys: list[str], article: str, content: str) -> DataFrame:
    """given with outcome: stored, present (ignored) or stale; if any is stale, none is stored (refused)."""
    fresh = given.join(articles.select(article, F.col(content).alias("_now")), article, "left")
    had = artifacts.select(*keys).distinct().withColumn("_had", F.lit(True))
    out = fresh.join(had, keys, "left").withColumn("outcome", F.when(~F.col(content).eqNullSafe(F.col("_now")), "stale").when(F.col("_had"), "present").otherwise("stored"))
    bad = out.agg(F.coalesce(F.bool_or(F.col("outcome") == "stale"), F.lit(False)).alias("_bad"))
    return out.join(F.broadcast(bad)).select(*given.columns, F.when(F.col("_bad") & (F.col("outcome") == "stored"), "refused").otherwise(F.col("outcome")).alias("outcome"))


def resolve_identities(given: DataFrame, articles: DataFrame, identity: list[str], id_col: str) -> DataFrame:
    """given with the id of the one article that agrees in all identity columns; null if there is none or several."""
    one = articles.groupBy(*identity).agg(F.count("*").alias("_n"), F.min(id_col).alias(id_col)).where("_n = 1").drop("_n")
    return given.join(one, identity, "left")


def order_violations(rows: DataFrame, within: str, position: str, keys: list[str]) -> DataFrame:
    """Rows that do not come after the one before them in the order of keys; equal keys are duplicates. A large group is checked in many ranges."""
    out = running(rows, [within], [F.col(position)], {"_before": ("last", F.struct(*keys))})
    key, before = F.struct(*keys), F.col("_before")
    return out.withColumn("violation", F.when(before == key, "duplicate").when(before > key, "order")).where("violation IS NOT NULL").drop("_before")


def stalled(attempts: DataFrame, jobs: DataFrame, before: Column) -> DataFrame:
    """Attempts (job_id, state, started) of running jobs that were sent and have had no answer since `before`: their outcome is unknown."""
    return attempts.where(F.col("state") == "sent").join(jobs.where(F.col("state") == "running").select("job_id"), "job_id").where(F.col("started") < before)


def clear_after_success(holds: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Holds (keys, hold_class, legacy_pair) that no success (keys, task, fields) on the same keys settles; see settled_by_success()."""
    ways = done.groupBy(*keys).agg(F.collect_set(F.struct("task", F.array_sort(F.array_distinct("fields")).alias("fields"))).alias("_ways"))  # tasks and sets of fields are few
    settled = F.exists(F.coalesce("_ways", F.array().cast(ways.schema["_ways"].dataType)), lambda w: settled_by_success(F.col("hold_class"), w["task"], w["fields"], F.col("legacy_pair")))
    return holds.join(ways, keys, "left").where(~settled).drop("_ways")
