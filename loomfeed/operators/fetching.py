"""Fetches as data: what recorded responses mean, where redirects lead, which snapshots serve a request."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gates import fetch_url
from ..functions.udf import arrow
from ..session import discard, materialise
from .folds import latest_by

# Statuses that lead elsewhere, statuses after which one more try may help, content types that are pages.
REDIRECTS, AGAIN, PAGES = (301, 302, 303, 307, 308), (429, 500, 502, 503, 504), ("text/html", "application/xhtml+xml")


@arrow("string")
def joined_url(base: pa.Array, location: pa.Array) -> pa.Array:
    """A location as seen from a page; null where there is none or it is no URL."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return urljoin(b or "", x) if x else None
        except ValueError:
            return None

    return pa.array([one(*x) for x in zip(base.to_pylist(), location.to_pylist(), strict=True)], pa.string())


def response_step(status: Column, wait: Column, attempt: Column, attempts: int = 2, most_wait: float = 10.0) -> Column:
    """not_modified, ok, retry or failed. A try is repeated after a passing trouble, if one is left and the wait asked for (seconds, null for none) is short."""
    again = status.isin(*AGAIN) & (attempt < attempts) & (F.coalesce(wait, F.lit(0.0)) <= most_wait)
    return F.when(status == 304, "not_modified").when(status.between(200, 299), "ok").when(again, "retry").otherwise("failed")


def page_fault(status: Column, content_type: Column, encoding: Column, announced: Column, n_bytes: Column, most_bytes: int = 4_000_000) -> Column:
    """Why a final response is no page to read, or null: its status, type, encoding, or size as announced or as it is."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    length = F.trim(F.coalesce(announced, F.lit("")))
    said = length.try_cast("long")
    return F.when(status != 200, F.concat(F.lit("status_"), status.cast("string"))).when(~kind.isin(*PAGES), "content_type").when(~F.lower(F.trim(F.coalesce(encoding, F.lit("")))).isin("", "identity"), "encoding").when((length != "") & (said.isNull() | (said < 0)), "length").when((said > most_bytes) | (n_bytes > most_bytes), "too_large")


def followed(requests: DataFrame, responses: DataFrame, hosts: str, redirects: int = 5, most_bytes: int = 4_000_000) -> DataFrame:
    """requests (id, url, hosts) with final_url, hops and outcome, by the recorded responses.

    responses: url (in its fetch_url() form, once), status, location, content_type,
    content_encoding, content_length, n_bytes. Every hop is put into its form and must be of
    one of the request's hosts. Outcomes: ok, invalid_url, not_allowed, loop, no_response,
    no_location, too_many_redirects, or what page_fault() names. A round joins the requests
    that are still under way; there are redirects + 2 at most, however long chains are.
    """
    answers = responses.select(F.col("url").alias("_url"), *[c for c in ("status", "location", "content_type", "content_encoding", "content_length", "n_bytes")], F.lit(True).alias("_answered"))
    way = requests.select("id", hosts, fetch_url(F.col("url")).alias("_at"), F.array().cast("array<string>").alias("_seen"), F.lit(0).alias("hops"))
    done, old = None, None
    for _ in range(redirects + 2):
        host = F.regexp_extract("_at", r"^https?://(\[[^\]]*\]|[^/]*)", 1)
        j = way.join(answers, F.col("_at") == F.col("_url"), "left")
        elsewhere = F.col("status").isin(*REDIRECTS)
        outcome = (
            F.when(F.col("_at").isNull(), "invalid_url")
            .when(~F.coalesce(F.array_contains(hosts, F.regexp_replace(host, r"^\[|\]$", "")), F.lit(False)), "not_allowed")
            .when(F.array_contains("_seen", F.col("_at")), "loop")
            .when(F.col("_answered").isNull() | F.col("status").isNull(), "no_response")
            .when(elsewhere & (F.coalesce("location", F.lit("")) == ""), "no_location")
            .when(elsewhere & (F.col("hops") >= redirects), "too_many_redirects")
            .when(elsewhere, "under_way")
            .otherwise(F.coalesce(page_fault(F.col("status"), F.col("content_type"), F.col("content_encoding"), F.col("content_length"), F.col("n_bytes"), most_bytes), F.lit("ok")))
        )
        j = materialise(j.withColumn("outcome", outcome).withColumn("_next", F.when(F.col("outcome") == "under_way", joined_url("_at", "location"))), "hops")
        ended = j.where("outcome <> 'under_way'").select("id", F.col("_at").alias("final_url"), "hops", "outcome")
        done = ended if done is None else done.unionByName(ended)
        if old is not None:
            discard(old)
        way = j.where("outcome = 'under_way'").select("id", hosts, fetch_url(F.col("_next")).alias("_at"), F.concat("_seen", F.array("_at")).alias("_seen"), (F.col("hops") + 1).alias("hops"))
        if way.isEmpty():
            break
        way = old = materialise(way, "under-way")
    return done


def read_through(requests: DataFrame, snapshots: DataFrame, policy: str, version: str) -> DataFrame:
    """requests (article_id, url, refresh) with snapshot_id and step: cached, fetch_and_store, fetch or refused.

    Under fetch_on_demand_cached_local the newest snapshot (retrieved_at, then id) of an article serves it if it
    is of the same URL and extractor version and no refresh is asked for; otherwise the page is
    fetched and stored. Under fetch_on_demand it is fetched each time and not stored; under
    metadata_only requests are refused.
    """
    if policy == "metadata_only":
        return requests.select("*", F.lit(None).cast("long").alias("snapshot_id"), F.lit("refused").alias("step"))
    if policy != "fetch_on_demand_cached_local":
        return requests.select("*", F.lit(None).cast("long").alias("snapshot_id"), F.lit("fetch").alias("step"))
    last = latest_by(snapshots.select("article_id", "retrieved_at", "id", F.col("canonical_url").alias("_url"), "extractor_version"), ["article_id"], "retrieved_at", "id")
    j = requests.join(last.select("article_id", F.col("id").cast("long").alias("_id"), "_url", "extractor_version"), "article_id", "left")
    hit = F.coalesce((F.col("_url") == F.col("url")) & (F.col("extractor_version") == version) & ~F.coalesce("refresh", F.lit(False)), F.lit(False))
    return j.select(*requests.columns, F.when(hit, F.col("_id")).alias("snapshot_id"), F.when(hit, "cached").otherwise("fetch_and_store").alias("step"))
