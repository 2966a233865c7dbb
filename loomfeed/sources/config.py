"""The configuration of sources: a JSON object read on the driver, checked and made a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

TEXTS = ("slug", "name", "home_url", "fetch_url", "adapter", "sitemap_url", "sitemap_prefix", "metadata_url", "zh_locale_url")
# Defaults and ranges of the numbers.
NUMBERS = {"history_limit": (50, 1, 500), "sitemap_interval_hours": (24, 1, 720)}
SCHEMA = "position int, " + ", ".join(f"{k} string" for k in TEXTS) + ", " + ", ".join(f"{k} int" for k in NUMBERS) + ", enabled boolean"


def problems(source: dict, adapters: tuple[str, ...]) -> list[str]:
    """What is wrong with one source, in the order in which it is checked."""
    out = [f"{k} is required" for k in ("slug", "name", "fetch_url") if not source[k]]
    if source["adapter"] not in adapters:
        out.append(f"unsupported adapter {source['adapter']}")
    out += [f"{k} must be from {low} to {high}" for k, (_, low, high) in NUMBERS.items() if not low <= source[k] <= high]
    if bool(source["sitemap_url"]) != bool(source["sitemap_prefix"]):
        out.append("sitemap_url and sitemap_prefix go together")
    return out


def read_sources(text: str, adapters: tuple[str, ...]) -> list[dict]:
    """The sources in the order of the file; ValueError names all faults."""
    given = json.loads(text).get("sources")
    if not isinstance(given, list) or not given or not all(isinstance(s, dict) for s in given):
        raise ValueError("sources must be a list of objects that is not empty")
    out, bad, seen = [], [], set()
    for i, raw in enumerate(given):
        row = {"position": i, **{k: str(raw.get(k, "")).strip() for k in TEXTS}, **{k: int(raw.get(k, d)) for k, (d, _, _) in NUMBERS.items()}, "enabled": bool(raw.get("enabled", True))}
        bad += [f"source {i}: {p}" for p in problems(row, adapters)]
        if row["slug"] in seen:
            bad.append(f"source {i}: slug {row['slug']} is used twice")
        seen.add(row["slug"])
        out.append(row)
    if bad:
        raise ValueError("; ".join(bad))
    return out


def sources_table(spark: SparkSession, text: str, adapters: tuple[str, ...]) -> DataFrame:
    """One row per source; position is its place, by which sources are processed."""
    return spark.createDataFrame(read_sources(text, adapters), SCHEMA)
