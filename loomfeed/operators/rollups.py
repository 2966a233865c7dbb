"""Counts and summaries that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_since(attempts: DataFrame, baseline: Column | int) -> DataFrame:
    """One row: what the attempts (id, state, input, output, paid) after the baseline id add up to."""
    a = attempts.where(F.col("id") > baseline)
    n = lambda c: F.count_if(c).cast("long")
    state = F.col("state")
    return a.agg(
        F.count("*").alias("attempts"), n(state == "succeeded").alias("succeeded"), n(state == "failed").alias("failed"), n(state == "ambiguous").alias("ambiguous"), n(state == "sent").alias("open"), n(F.col("paid")).alias("paid"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input", "output")), F.coalesce(F.sum(F.col("input") + F.col("output")), F.lit(0)).cast("long").alias("total"), F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last_id"),
    )


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def class_counts(rows: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """One row with a count for each class, those without rows too."""
    return rows.agg(*(F.count_if(F.col(column) == c).cast("long").alias(c) for c in classes))


def run_rollup(results: DataFrame) -> DataFrame:
    """results (source, ok, unread_new): per source whether any failed and its new rows, without sources that have neither."""
    out = results.groupBy("source").agg(F.bool_or(~F.col("ok")).alias("failed"), F.sum("unread_new").cast("long").alias("unread_new"))
    return out.where(F.col("failed") | (F.col("unread_new") > 0))


def resolve_counts(given: DataFrame, sources: DataFrame, listed: DataFrame) -> DataFrame:
    """One row (total, unread): given counts, else the sums over sources, else those of the list."""
    g = given.agg(F.max("total").alias("g_total"), F.max("unread").alias("g_unread"))
    s = sources.agg(F.sum("total").alias("s_total"), F.sum("unread").alias("s_unread"))
    items = listed.agg(F.count("*").alias("l_total"), F.count_if(~F.col("seen")).alias("l_unread"))
    return g.join(F.broadcast(s)).join(F.broadcast(items)).select(*(F.coalesce(f"g_{c}", f"s_{c}", f"l_{c}").cast("long").alias(c) for c in ("total", "unread")))


def run_summary(scanned: Column, hits: Column, succeeded: Column, holds_before: Column, holds_after: Column) -> list[Column]:
    """untranslated and new_holds, neither below zero."""
    return [F.greatest(scanned - hits - succeeded, F.lit(0)).cast("long").alias("untranslated"), F.greatest(holds_after - holds_before, F.lit(0)).cast("long").alias("new_holds")]


def parsed_and_dated(rows: DataFrame, source: str, date: str) -> DataFrame:
    return rows.groupBy(source).agg(F.count("*").alias("parsed"), F.count(date).alias("dated"))


def locale_counters(rows: DataFrame) -> DataFrame:
    """rows (fetched, stored): stored, fetched but not stored, and skipped."""
    n = lambda c: F.count_if(c).cast("long")
    return rows.agg(n(F.col("stored")).alias("stored"), n(F.col("fetched")).alias("fetched"), n(~F.col("fetched")).alias("skipped"))


def audit_list(attempts: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """Attempts with their job's columns, newest first, ties by id; limit 1 to 1000."""
    return attempts.join(jobs, "job_id").orderBy(F.desc("started"), F.desc("id")).limit(max(1, min(limit, 1000)))


def preview(requests: DataFrame, artifacts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """One row: requests, those an artifact answers, and the tokens of the rest."""
    had = artifacts.select(key).distinct().withColumn("_had", F.lit(True))
    r = requests.join(had, key, "left")
    return r.agg(F.count("*").alias("requests"), F.count("_had").alias("cached"), F.coalesce(F.sum(F.when(F.col("_had").isNull(), tokens)), F.lit(0)).cast("long").alias("tokens"))


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)
