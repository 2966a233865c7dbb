"""State tables as pure functions: (state, changes) -> new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import backoff_seconds
from .folds import latest_by, newest
from .joins import either_key_match
from .scan import running

# Risk of a hold, by class.
RISK = {"fallback_pending": 1, "paid_failure": 2, "ambiguous": 3}


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], columns: dict[str, Column] | None = None) -> DataFrame:
    """state with the changed rows put in by key. columns may combine n.<column> (new) and o.<column> (old); default: the new value."""
    o, n = state.alias("o"), changes.alias("n")
    cond = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    j = o.join(n, cond, "full_outer")
    hit = F.col(f"n.{keys[0]}").isNotNull()
    out = []
    for c in state.columns:
        new = (columns or {}).get(c, F.col(f"n.{c}") if c in changes.columns else F.col(f"o.{c}"))
        out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in keys else F.when(hit, new).otherwise(F.col(f"o.{c}")).alias(c))
    return j.select(*out)


def merge_by_either_key(state: DataFrame, batch: DataFrame, within: str, key_a: str, key_b: str, fields: list[str], pos: str) -> DataFrame:
    """The merged state with change: kept, updated, inserted or baseline.

    state: id, within, keys, fields, seen (boolean); batch: within, keys, fields, pos. A batch
    row belongs to the stored row of the smallest id that has either key; of several
    batch rows for one stored row, or with one key, the last position wins. Rows of a
    source without any stored row are its baseline and count as seen; others are
    inserted unseen. A row updates only if a field differs; seen survives. New rows get the
    ids after the largest, so the result without `change` is the next state.
    """
    last = latest_by(latest_by(batch, [within, key_a], pos), [within, key_b], pos)
    match = either_key_match(last.withColumn("_p", F.col(pos)), state, "_p", within, key_a, key_b, "id")
    b = last.join(match.withColumnRenamed("_p", pos), pos, "left")
    hit = latest_by(b.where("match_id IS NOT NULL"), ["match_id"], pos)
    new = b.where("match_id IS NULL")
    data = [key_a, key_b, *fields]
    n = hit.select(F.col("match_id").alias("id"), *[F.col(c).alias(f"n_{c}") for c in data])
    j = state.join(n, "id", "left")
    got = F.col(f"n_{key_a}").isNotNull()
    differs = got & ~F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in data]), lambda x: x)
    old = j.select("id", within, *[F.when(differs, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in data], "seen", F.when(differs, "updated").otherwise("kept").alias("change"))
    sources = state.select(within).distinct().withColumn("_known", F.lit(True))
    known = F.col("_known").isNotNull()
    ins = new.join(sources, within, "left").select(within, *data, (~known).alias("seen"), F.when(known, "inserted").otherwise("baseline").alias("change"))
    # numbers in many small windows, carried on by the counts of the groups before
    ins = ins.withColumn("_g", F.pmod(F.xxhash64(within, key_a, key_b), F.lit(1024)))
    before = ins.groupBy("_g").count().select("_g", (F.sum("count").over(Window.orderBy("_g")) - F.col("count")).alias("_before"))
    top = state.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    nth = F.row_number().over(Window.partitionBy("_g").orderBy(within, key_a, key_b))
    ins = ins.withColumn("_n", nth).join(before, "_g").join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_before") + F.col("_n"))
    return old.unionByName(ins.select(old.columns))


def merge_counts(merged: DataFrame, within: str) -> DataFrame:
    return merged.groupBy(within).agg(*(F.count_if(F.col("change") == c).cast("long").alias(f"n_{c}") for c in ("inserted", "updated", "baseline", "kept")))


def last_writer_wins(local: DataFrame, incoming: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The newer row of each key; the incoming one on equal stamps."""
    both = local.withColumn("_w", F.lit(0)).unionByName(incoming.withColumn("_w", F.lit(1)))
    return latest_by(both, keys, stamp, "_w").drop("_w")


def record_failures(pending: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """pending with attempts + 1, the error and the next due time of the failed rows. failures: keys, error, failed_at, retry_after (seconds or null)."""
    f = failures.select(*keys, F.col("error").alias("_e"), F.col("failed_at").alias("_t"), F.col("retry_after").alias("_r"))
    hit, n = F.col("_t").isNotNull(), F.col("attempts") + 1
    delay = F.when(F.col("_r").isNotNull(), F.least(F.greatest("_r", F.lit(0)), F.lit(86400))).otherwise(backoff_seconds(n))
    j = pending.join(f, keys, "left")
    return j.withColumns({"attempts": F.when(hit, n).otherwise(F.col("attempts")), "last_error": F.when(hit, F.col("_e")).otherwise(F.col("last_error")), "next_attempt": F.when(hit, F.timestamp_seconds(F.unix_timestamp("_t") + delay)).otherwise(F.col("next_attempt"))}).drop("_e", "_t", "_r")


def due(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """Due rows: new before modified, then first seen, then url."""
    ready = queue.where(F.col("next_attempt").isNull() | (F.col("next_attempt") <= now))
    return newest(ready, limit, F.when(F.col("change") == "new", 0).otherwise(1), F.col("first_seen"), F.col("url"))


def queue_head(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next eligible jobs: queued or retryable, attempts left, due; by priority, age and id."""
    ok = F.col("state").isin("queued", "retry") & (F.col("attempts") < F.col("max_attempts")) & (F.col("due").isNull() | (F.col("due") <= now))
    return newest(jobs.where(ok), n, F.col("priority"), F.col("created"), F.col("id"))


def recover_stalled(jobs: DataFrame, now: Column, seconds: int = 900) -> DataFrame:
    """Running jobs without a sign for `seconds` go back to the queue, or fail if a request was already sent."""
    stalled = (F.col("state") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("updated") > seconds)
    return jobs.withColumn("state", F.when(stalled & F.col("sent"), "failed").when(stalled, "queued").otherwise(F.col("state")))


def highest_risk(holds: DataFrame, key: str) -> DataFrame:
    """The class of the highest risk of each key and the smallest id that has it."""
    rank = F.coalesce(*(F.when(F.col("hold_class") == c, r) for c, r in RISK.items()), F.lit(0))
    return holds.groupBy(key).agg(F.max(F.struct(rank.alias("risk"), (-F.col("id")).alias("i"), F.col("hold_class").alias("c"))).alias("m")).select(key, F.col("m.c").alias("hold_class"), (-F.col("m.i")).alias("id"))


def purge(df: DataFrame, stamp: str, before: Column) -> DataFrame:
    return df.where(~(F.col(stamp) < before))


def health(df: DataFrame, now: Column, stale_hours: int = 26) -> Column:
    """error, never_synced, degraded, stale or healthy, in this precedence."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_success")) / 3600
    return F.when(F.coalesce("last_error", F.lit("")) != "", "error").when(F.col("last_success").isNull(), "never_synced").when((F.coalesce("check_errors", F.lit("")) != "") | (F.coalesce("n_pending", F.lit(0)) > 0), "degraded").when(age > stale_hours, "stale").otherwise("healthy")


def cache_validators(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The HTTP cache after fetches: a not-modified answer keeps old validators where the new ones are empty."""
    keep = lambda c: F.when(F.col("n.status") == 304, F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}"))).otherwise(F.col(f"n.{c}"))
    return upsert(cache, fetched, ["url"], {"etag": keep("etag"), "last_modified": keep("last_modified")})


def check_streaks(checks: DataFrame, keys: list[str], at: str, ok: str) -> DataFrame:
    """keys, failures: consecutive failures since the last success."""
    last_ok = checks.where(F.col(ok)).groupBy(*keys).agg(F.max(at).alias("_ok"))
    after = checks.where(~F.col(ok)).join(last_ok, keys, "left").where(F.col("_ok").isNull() | (F.col(at) > F.col("_ok")))
    n = after.groupBy(*keys).agg(F.count("*").alias("failures"))
    return checks.select(*keys).distinct().join(n, keys, "left").select(*keys, F.coalesce("failures", F.lit(0)).alias("failures"))


def mark_read(articles: DataFrame, where: Column, now: Column) -> DataFrame:
    """articles with read_at set where it was not, and the column changed."""
    hit = where & F.col("read_at").isNull()
    return articles.withColumns({"read_at": F.when(hit, now).otherwise(F.col("read_at")), "changed": F.coalesce(hit, F.lit(False))})


def insert_missing(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """state and the rows whose key it does not have; of several new rows of a key one."""
    new = rows.dropDuplicates([key]).join(state.select(key), key, "left_anti")
    return state.unionByName(new)


def next_numbers(rows: DataFrame, state: DataFrame, number: str, within: str, order: list[str]) -> DataFrame:
    """rows numbered after the largest number that their group has in state; a large group is numbered in many ranges."""
    top = state.groupBy(within).agg(F.max(number).alias("_top"))
    numbered = running(rows, [within], [F.col(c) for c in order], {"_nth": ("count", None)})
    return numbered.join(top, within, "left").withColumn(number, F.coalesce("_top", F.lit(0)) + F.col("_nth")).drop("_top", "_nth")
