"""From an article to its output: what to do next, queue operations, drift checks, import of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.artifacts import checked_output, paid_retry_authorized
from .subsets import named_set

# States of a job that a request may run at once, and those that only a request with leave may take up again.
OPEN, ENDED = ("queued", "leased", "retryable", "budget_blocked"), ("cancelled", "unknown", "permanent_failed")


def next_steps(requests: DataFrame, current: DataFrame, holds: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """requests (key, force, retry_paid) with step: cached, held_ambiguous, held_paid, enqueue, requeue, run or refused.

    A current output answers at once. Then holds speak: an ambiguous one stops a request
    unless it is forced, a paid failure unless a paid retry is authorised (nothing but paid
    failures and pending fallbacks) or it is forced. Then the job: none is queued; a
    cancelled one is queued again; of those that ended, force takes up unknown and
    failed ones, an authorised retry failed ones; open ones run; others refuse.
    """
    kinds = holds.groupBy(key).agg(F.collect_set("hold_class").alias("_holds"))  # three classes
    r = requests.join(current.select(key, F.lit(True).alias("_have")).distinct(), key, "left").join(kinds, key, "left").join(jobs.select(key, F.col("state").alias("_state")), key, "left")
    force, retry = (F.coalesce(c, F.lit(False)) for c in ("force", "retry_paid"))
    has = lambda c: F.coalesce(F.array_contains("_holds", c), F.lit(False))
    paid = retry & paid_retry_authorized(F.coalesce("_holds", F.array().cast("array<string>")))
    again = (F.col("_state") == "cancelled") | (force & F.col("_state").isin("unknown", "permanent_failed")) | (paid & (F.col("_state") == "permanent_failed"))
    step = F.when(F.col("_have"), "cached").when(has("ambiguous") & ~force, "held_ambiguous").when(has("paid_failure") & ~paid & ~force, "held_paid").when(F.col("_state").isNull(), "enqueue").when(again, "requeue").when(F.col("_state").isin(*OPEN), "run").otherwise("refused")
    return r.withColumn("step", step).drop("_have", "_holds", "_state")


def enqueue(jobs: DataFrame, given: DataFrame, key: str, client: str) -> DataFrame:
    """given (key, client, ...) with outcome: queued, present, or rebound if its client id belongs to another key; of several new rows of a key the first client id in order is queued.

    Client ids may be null. A client id that two new keys claim is rebound for all but the
    first key in order. Rows that repeat both have one outcome and count once.
    """
    stored = jobs.select(key, F.col(client).alias("_client")).distinct()
    owner = stored.where("_client IS NOT NULL").select(F.col("_client").alias(client), F.col(key).alias("_owner"))
    first = given.groupBy(key).agg(F.min(F.coalesce(client, F.lit(""))).alias("_first"))
    claims = given.where(F.col(client).isNotNull()).groupBy(client).agg(F.min(key).alias("_claim"))
    j = given.join(stored.select(key, F.lit(True).alias("_had")).distinct(), key, "left").join(owner, client, "left").join(first, key).join(claims, client, "left")
    taken = (F.col("_owner").isNotNull() & (F.col("_owner") != F.col(key))) | (F.col("_owner").isNull() & F.col("_claim").isNotNull() & (F.col("_claim") != F.col(key)))
    outcome = F.when(taken, "rebound").when(F.col("_had") | (F.coalesce(client, F.lit("")) != F.col("_first")), "present").otherwise("queued")
    return j.select(*given.columns, outcome.alias("outcome"))


def retry_jobs(jobs: DataFrame, asked: DataFrame, key: str, now: Column, allow_unknown: bool = False) -> DataFrame:
    """jobs after those asked for went back to the queue: cancelled and permanently failed ones, unknown ones with leave; attempts left are at least one more."""
    j = jobs.join(asked.select(key, F.lit(True).alias("_asked")).distinct(), key, "left")
    hit = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("state").isin("cancelled", "permanent_failed", *(["unknown"] if allow_unknown else []))
    new = {"state": F.when(hit, "queued").otherwise(F.col("state")), "max_attempts": F.when(hit, F.greatest("max_attempts", F.col("attempts") + 1)).otherwise(F.col("max_attempts")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "changed": hit}
    return j.withColumns(new).drop("_asked")


def drift(jobs: DataFrame, articles: DataFrame, prepared: DataFrame, key: str) -> DataFrame:
    """jobs (key, article_id, content_hash, input_hash, artifact_key) with drift: gone, article, input, configuration or null.

    articles: id, content_hash now; prepared: key, input_hash, artifact_key as they would be made now.
    """
    now = articles.select(F.col("id").alias("article_id"), F.coalesce("content_hash", F.lit("")).alias("_content"))
    made = prepared.select(key, F.col("input_hash").alias("_input"), F.col("artifact_key").alias("_artifact"))
    j = jobs.join(now, "article_id", "left").join(made, key, "left")
    what = F.when(F.col("_content").isNull(), "gone").when(~F.col("content_hash").eqNullSafe(F.col("_content")), "article").when(~F.col("input_hash").eqNullSafe(F.col("_input")), "input").when(~F.col("artifact_key").eqNullSafe(F.col("_artifact")), "configuration")
    return j.select(*jobs.columns, what.alias("drift"))


def import_results(results: DataFrame, articles: DataFrame, stored: DataFrame, tasks: list[str], language: str) -> DataFrame:
    """results (item, base, fingerprint, article_id, content_hash, task, output) with outcome and readable.

    In order: unknown_request if no set of tasks gave the fingerprint for its base, not_asked
    if the task is not in that set, repeated if the item has the task twice, stale if the
    article is gone or has changed, broken if the output breaks its contract, present if the
    article has a stored output of the task for this content, else stored. If any is none of the last two, the
    whole batch is refused: what would be stored is marked refused. readable: the text of outputs
    that are stored, present or refused in this way.
    """
    asked = named_set(F.col("base"), F.col("fingerprint"), tasks)
    now = articles.select(F.col("id").alias("article_id"), F.col("content_hash").alias("_now"))
    had = stored.select("article_id", "task", "content_hash").distinct().withColumn("_had", F.lit(True))
    twice = results.groupBy("item", "task").count().where("count > 1").select("item", "task", F.lit(True).alias("_twice"))
    j = results.withColumn("_asked", asked).withColumn("_r", checked_output(F.col("task"), F.col("output"), F.lit(language), empty_summary=True))
    j = j.join(now, "article_id", "left").join(had, ["article_id", "task", "content_hash"], "left").join(twice, ["item", "task"], "left")
    outcome = F.when(F.col("_asked").isNull(), "unknown_request").when(~F.array_contains("_asked", F.col("task")), "not_asked").when(F.col("_twice"), "repeated").when(~F.col("content_hash").eqNullSafe(F.col("_now")), "stale").when(F.col("_r.error").isNotNull(), "broken").when(F.col("_had"), "present").otherwise("stored")
    j = j.withColumn("outcome", outcome)
    bad = j.agg(F.coalesce(F.bool_or(~F.col("outcome").isin("stored", "present")), F.lit(False)).alias("_bad"))
    out = j.join(F.broadcast(bad))  # one row
    return out.select(*results.columns, F.when(F.col("_bad") & (F.col("outcome") == "stored"), "refused").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("outcome").isin("stored", "present"), F.col("_r.readable")).alias("readable"))


def first_known(rows: DataFrame, key: str, tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """rows with columns from the first of several look-up tables (key, columns) that has the key, and found: its number from 0, null if none has it. Tables have a key once."""
    out = rows
    for i, t in enumerate(tables):
        out = out.join(t.select(key, F.struct(F.lit(i).alias("found"), *columns).alias(f"_t{i}")), key, "left")
    got = F.coalesce(*[F.col(f"_t{i}") for i in range(len(tables))])
    return out.select(*rows.columns, *[got[c].alias(c) for c in columns], got["found"].alias("found"))


def pending_counts(sources: DataFrame, pending: DataFrame, source: str) -> DataFrame:
    """Every source with the number of its pending rows."""
    n = pending.groupBy(source).agg(F.count("*").alias("n_pending"))
    return sources.join(n, source, "left").withColumn("n_pending", F.coalesce("n_pending", F.lit(0)).cast("long"))
