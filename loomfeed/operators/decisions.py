"""Decision tables over recorded outcomes: failure classes, admission past holds, settlement of attempts, reported usage."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow
from ..functions.values import canonical_json

# Response codes after which the outcome is unknown, or another provider may be tried.
AMBIGUOUS = (408, 409, 425)
FALLBACK = (401, 402, 404, 429)
FALLBACK_CODES = ("provider_overloaded", "provider_unavailable", "rate_limit_exceeded", "thinking_output", "thinking_tokens", "tool_calls", "no_output", "finish_length", "finish_error", "finish_reason", "invalid_structured_output")


def failure_class(status: Column, code: Column) -> Column:
    """ambiguous, fallback or final. Server errors leave the outcome unknown."""
    return F.when(status.isin(*AMBIGUOUS) | (status >= 500), "ambiguous").when(status.isin(*FALLBACK) | F.coalesce(code.isin(*FALLBACK_CODES), F.lit(False)), "fallback").otherwise("final")


def admission(requests: DataFrame, holds: DataFrame, key: str) -> DataFrame:
    """requests (key, retry_paid, force) with decision.

    An ambiguous hold stops a request unless it is forced; a paid failure stops it unless
    a paid retry is asked for; a pending fallback goes on where it stopped.
    """
    kinds = holds.groupBy(key).agg(F.some(F.col("hold_class") == "ambiguous").alias("_a"), F.some(F.col("hold_class") == "paid_failure").alias("_p"), F.some(F.col("hold_class") == "fallback_pending").alias("_f"))
    r = requests.join(kinds, key, "left")
    hit = lambda c: F.coalesce(c, F.lit(False))
    decision = F.when(hit("_a") & ~F.col("force"), "held_ambiguous").when(hit("_p") & ~F.col("retry_paid") & ~F.col("force"), "held_paid").when(hit("_f"), "continue").otherwise("send")
    return r.withColumn("decision", decision).drop("_a", "_p", "_f")


def settle(attempts: DataFrame, outcomes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """attempts after their outcomes: attempts without one stay.

    outcomes: id, ok, status, code, used (tokens or null). A success or a known usage ends
    the reservation; an ambiguous failure keeps it; a failure is retried while attempts are left
    and it is not final.
    """
    o = outcomes.select("id", F.lit(True).alias("_hit"), "ok", "status", "code", "used")
    j = attempts.join(o, "id", "left")
    kind = F.when(F.col("ok"), "done").otherwise(failure_class(F.col("status"), F.col("code")))
    new = F.when(F.col("ok"), "succeeded").when(kind == "ambiguous", "ambiguous").when((kind == "fallback") & (F.col("attempt") < max_attempts), "retry").otherwise("failed")
    keeps = F.coalesce((kind == "ambiguous") & F.col("used").isNull(), F.lit(False))
    hit = F.col("_hit").isNotNull()
    return j.select(
        *[c for c in attempts.columns if c not in ("state", "reservation_active", "actual_total")],
        F.when(hit, new).otherwise(F.col("state")).alias("state"),
        F.when(hit & ~keeps, 0).otherwise(F.col("reservation_active")).alias("reservation_active"),
        F.when(hit, F.col("used")).otherwise(F.col("actual_total")).alias("actual_total"),
    )


_USAGE = "struct<input_tokens:long,output_tokens:long,total_tokens:long,prompt_tokens:long,completion_tokens:long,input_tokens_details:struct<cached_tokens:long>,prompt_tokens_details:struct<cached_tokens:long>,output_tokens_details:struct<reasoning_tokens:long>>"


def reported_usage(payload: Column) -> Column:
    """struct(input, cached, output, reasoning, total, complete) of either payload shape; total is at least input + output."""
    u = F.from_json(payload, _USAGE)
    i, o = F.coalesce(u["input_tokens"], u["prompt_tokens"]), F.coalesce(u["output_tokens"], u["completion_tokens"])
    cached = F.coalesce(u["input_tokens_details"]["cached_tokens"], u["prompt_tokens_details"]["cached_tokens"], F.lit(0))
    total = F.greatest(F.coalesce(u["total_tokens"], F.lit(0)), F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0)))
    return F.struct(i.alias("input"), cached.alias("cached"), o.alias("output"), F.coalesce(u["output_tokens_details"]["reasoning_tokens"], F.lit(0)).alias("reasoning"), total.alias("total"), (i.isNotNull() & o.isNotNull() & (cached <= i)).alias("complete"))


def fit_one(fields: dict[str, str], longest: str, limit: int) -> dict[str, str] | None:
    """The fields with the longest prefix of one of them whose canonical JSON has at most `limit` bytes; None if none fits."""
    size = lambda n: len(canonical_json(fields | {longest: fields[longest][:n]}).encode())
    if size(0) > limit:
        return None
    low, high = 0, len(fields[longest])
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if size(mid) <= limit else (low, mid - 1)
    return fields | {longest: fields[longest][:low]}


def fit_payload(longest: Column, limit: int, **others: Column) -> Column:
    """Canonical JSON of the fields `text` and others within the limit, text cut as little as possible; null if it cannot fit."""
    names = sorted(others)

    def run(text: pa.Array, *rest: pa.Array) -> pa.Array:
        out = []
        for t, *r in zip(text.to_pylist(), *(x.to_pylist() for x in rest), strict=True):
            got = fit_one({"text": t or ""} | {k: v or "" for k, v in zip(names, r, strict=True)}, "text", limit)
            out.append(None if got is None else canonical_json(got))
        return pa.array(out, pa.string())

    return arrow("string")(run)(longest, *(others[k] for k in names))


@arrow("boolean")
def valid_json(value: pa.Array) -> pa.Array:
    """True for one JSON object without repeated keys and non-finite numbers; null stays null."""

    def unique(pairs):
        if len(dict(pairs)) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def bad(name):
        raise ValueError(name)

    def ok(s):
        try:
            return isinstance(json.loads(s, object_pairs_hook=unique, parse_constant=bad), dict)
        except ValueError:
            return False

    return pa.array([None if s is None else ok(s) for s in value.to_pylist()], pa.bool_())
