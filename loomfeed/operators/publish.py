"""Published forms: digest lines, feed items, nested snapshots, packets within a size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_escape, output_text
from ..functions.values import canonical_json, rfc822
from .scan import running


def digest_line(title: Column, source: Column, when: Column, url: Column) -> Column:
    """A Markdown list line with defaults for an empty title or source."""
    t = F.coalesce(F.nullif(output_text(title), F.lit("")), F.lit("Untitled"))
    s = F.coalesce(F.nullif(output_text(source), F.lit("")), F.lit("Unknown source"))
    return F.concat(F.lit("- ["), markdown_escape(t), F.lit("]("), url, F.lit(") — "), markdown_escape(s), F.lit(" · "), F.substring(when, 1, 10))


def _xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def rss_item(title: Column, url: Column, summary: Column, ts: Column) -> Column:
    return F.concat(F.lit("<item><title>"), _xml(output_text(title)), F.lit("</title><link>"), _xml(url), F.lit('</link><guid isPermaLink="true">'), _xml(url), F.lit("</guid><pubDate>"), rfc822(ts), F.lit("</pubDate><description>"), _xml(output_text(summary)), F.lit("</description></item>"))


def snapshot_row(*cols: str) -> Column:
    """One JSON object with the columns in sorted order, nulls kept."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def public_projection(df: DataFrame, private: list[str], array: str, keep) -> DataFrame:
    """df without private columns, the array filtered, and its new length."""
    return df.drop(*private).withColumn(array, F.filter(array, keep)).withColumn(f"n_{array}", F.size(array).cast("long"))


def _packet(rows: list[dict], total: int, budget: int) -> dict:
    """The longest prefix whose canonical JSON fits; of the first row that does not, the longest summary prefix."""
    size = lambda items: len(canonical_json({"items": items, "omitted": total - len(items)}))
    items: list[dict] = []
    for r in rows:
        if size([*items, r]) <= budget:
            items.append(r)
            continue
        low, high = -1, len(r["summary"])
        while low < high:  # the largest prefix that fits
            mid = (low + high + 1) // 2
            if size([*items, r | {"summary": r["summary"][:mid]}]) <= budget:
                low = mid
            else:
                high = mid - 1
        if low >= 0:
            items.append(r | {"summary": r["summary"][:low]})
        break
    return {"json": canonical_json({"items": items, "omitted": total - len(items)}), "n_items": len(items)}


def packets(df: DataFrame, key: str, order: str, title: str, summary: str, budget: int) -> DataFrame:
    """key, json, n_items: for each key one packet of at most budget characters.

    Only rows that can be in the packet are gathered: those before which the running
    length is within the budget; the running length of a large key is taken in many ranges.
    """
    rows = df.select(key, F.col(order).alias("o"), F.coalesce(title, F.lit("")).alias("t"), F.coalesce(summary, F.lit("")).alias("s"))
    n = rows.groupBy(key).agg(F.count("*").alias("all"))
    near = running(rows, [key], [F.col("o")], {"used": ("sum", F.length("t") + F.length("s"))}, before=True).where(F.coalesce("used", F.lit(0)) <= budget)
    near = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "t", F.substring("s", 1, budget).alias("s")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, json, count = b.column(0), [], []
            for rows, total in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = _packet([{"title": r["t"], "summary": r["s"]} for r in rows or []], total, budget)
                json.append(got["json"])
                count.append(got["n_items"])
            yield pa.RecordBatch.from_arrays([keys, pa.array(json), pa.array(count, pa.int64())], names=[key, "json", "n_items"])

    kind = df.schema[key].dataType.simpleString()
    return n.join(near, key, "left").select(key, "rows", "all").mapInArrow(run, f"{key} {kind}, json string, n_items long")
