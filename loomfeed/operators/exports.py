"""What leaves a store: current outputs under portable names, rows without identifiers, holds by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_values import value_digest
from .folds import latest_by

TASKS = ("summary", "translation")
IDENTITY = ("source_slug", "external_id", "canonical_url", "content_hash")
# What a publisher's own translation has in place of a model and its settings.
_OWN = ("prompt_version", "response_schema_version", "provider", "requested_model", "resolved_model")
_OWN_HASHES = ("prompt_hash", "response_schema_hash", "generation_params_hash")
#: Columns that may be published of an attempt: times and numbers.
USAGE = ("request_started_at", "reservation_active", "reserved_total_tokens", "reserved_cost_micros", "actual_input_tokens", "actual_cached_input_tokens", "actual_cache_write_tokens", "actual_output_tokens", "actual_reasoning_tokens", "actual_total_tokens", "actual_cost_micros")


def exportable(artifacts: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Artifacts that may leave, with their article's identity and their source's name.

    Succeeded summaries and translations of metadata that depend on no other artifact or
    snapshot, made from what the article says now. artifacts: id, article_id, task_type,
    target_language, status, input_scope, source_artifact_id, content_snapshot_id,
    article_content_hash, created_at, ...; articles: id and IDENTITY; sources: slug, name.
    Filters go before the joins; an article or source that is not there drops its artifacts.
    """
    own = artifacts.where((F.col("status") == "succeeded") & F.col("task_type").isin(*TASKS) & (F.col("input_scope") == "metadata") & F.col("source_artifact_id").isNull() & F.col("content_snapshot_id").isNull())
    who = articles.select(F.col("id").alias("article_id"), *IDENTITY)
    j = own.join(who, (own["article_id"] == who["article_id"]) & (own["article_content_hash"] == who["content_hash"])).drop(who["article_id"])
    return j.join(sources.select(F.col("slug").alias("source_slug"), F.col("name").alias("source_name")), "source_slug")


def portable_artifact(provider: Column, row: list[str]) -> dict[str, Column]:
    """The portable columns of an artifact; a publisher's own output has no model, prompt or schema but `publisher` and its digest."""
    own = provider == "publisher"
    out = {c: F.col(c) for c in row}
    out |= {c: F.when(own, "publisher").otherwise(F.col(c)) for c in _OWN if c in row}
    return out | {c: F.when(own, F.sha2(F.lit("publisher"), 256)).otherwise(F.col(c)) for c in _OWN_HASHES if c in row}


def published_artifacts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of exportable() rows the newest of each identity, task and language (created_at, then id), in portable columns, with output_hash and cache_key.

    output is JSON text; output_hash is the digest of its canonical form, and rows whose
    output is not strict JSON are left out. cache_key is the digest of the canonical form of
    all published columns, so the same output has the same key anywhere.
    """
    keys = [*IDENTITY, "task_type", "target_language"]
    last = latest_by(rows, keys, "created_at", "id")
    shown = last.select(*keys, *[c.alias(n) for n, c in portable_artifact(F.col("provider"), [c for c in columns if c not in keys]).items()])
    shown = shown.withColumn("output_hash", value_digest(F.col("output"))).where("output_hash IS NOT NULL")
    whole = F.to_json(F.struct(*[F.col(c) for c in sorted(shown.columns) if c != "output"], F.parse_json("output").alias("output")), {"ignoreNullFields": "false"})
    return shown.withColumn("cache_key", value_digest(whole))


def current_artifact(artifacts: DataFrame, articles: DataFrame, valid: Column, keys: tuple[str, ...] = ("article_id", "task_type", "target_language", "input_scope")) -> DataFrame:
    """Of each key the newest artifact that was made from what its article says now and is valid; whoever made it.

    The newest of all comes first and is then judged, so an invalid newest one leaves its
    key without any, and the work is done again.
    """
    who = articles.select(F.col("id").alias("article_id"), F.col("content_hash").alias("article_content_hash"))
    fresh = artifacts.where("status = 'succeeded'").join(who, ["article_id", "article_content_hash"])
    return latest_by(fresh, list(keys), "created_at", "id").where(F.coalesce(valid, F.lit(False)))


def usage_rows(attempts: DataFrame) -> DataFrame:
    """Attempts as times and numbers; nothing that names a job, a provider's answer or a text."""
    return attempts.select(*USAGE)


def hold_key(descriptor: Column) -> Column:
    """The key of a hold: the digest of its descriptor's canonical form."""
    return value_digest(descriptor)


def hold_rows(holds: DataFrame, forbidden: tuple[str, ...], longest: int = 100_000, with_revision: bool = False) -> DataFrame:
    """Holds (hold_key, workload_kind, hold_class, descriptor, created_at, updated_at, revision) with error: what stops one from leaving, or null.

    A descriptor must be a strict JSON object of at most `longest` bytes, name none of the
    forbidden members at any depth, and have the digest that is its key.
    """
    from ..functions.json_values import canonical_text, members

    d = F.col("descriptor")
    form, names = canonical_text(d), F.split(members(d), ",")
    error = F.when(F.octet_length(d) > longest, "too long").when(form.isNull() | ~form.startswith("{"), "no JSON object").when(F.arrays_overlap(names, F.array(*map(F.lit, forbidden))), "forbidden member").when(F.sha2(form, 256) != F.col("hold_key"), "another key")
    cols = ["hold_key", "workload_kind", "hold_class", "created_at", "updated_at"] + (["revision"] if with_revision else [])
    return holds.select(*cols, form.alias("descriptor"), error.alias("error"))
