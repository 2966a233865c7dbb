"""Removal of word windows that an earlier document holds, by super-k-mers.

A window is `width` consecutive words. Its minimiser is the smallest hash of the shorter
word runs in it. Consecutive windows that share their minimiser form a super-k-mer; equal
windows have equal minimisers, so they meet in the minimiser's bucket. Super-k-mers whose
minimiser only one text has are left out before any text moves; the others travel as one
packed string to their bucket, where their windows are sorted and compared exactly.
Buckets that hold very many super-k-mers are dealt out by window digest instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordnp
from .common import discard, materialise, partitions

#: Windows of one super-k-mer at most; a longer one is cut, which loses no window.
RUN = 256


def super_kmers(h: np.ndarray, bounds: np.ndarray, width: int, inner: int) -> tuple[np.ndarray, ...]:
    """text, minimiser, first window (word offset in its text) and number of windows of each super-k-mer."""
    low = wordnp.window_min(wordnp.grams(h, inner), width - inner + 1)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), np.maximum(n - width + 1, 0))
    if not len(text):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    count = np.maximum(n - width + 1, 0)
    first = np.cumsum(count) - count
    at = np.arange(len(text)) - first[text]  # word offset in the text
    value = (low[bounds[:-1][text] + at] >> np.uint64(1)).astype(np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    since = np.arange(len(text)) - np.repeat(start, np.diff(np.append(start, len(text))))
    start = np.flatnonzero(since % RUN == 0)
    return text[start], value[start], at[start], np.diff(np.append(start, len(text)))


def _spans(docs: DataFrame, width: int, inner: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off in wordnp.slices(b.column(1)):
                starts, ends, bounds = wordnp.words(data, off)
                text, mini, at, n = super_kmers(wordnp.hashes(data, starts, ends), bounds, width, inner)
                take = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays([pa.array(mini), b.column(0).take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["mini", "rid", "start", "n"])

    return docs.select("rid", "text").mapInArrow(run, "mini long, rid long, start int, n int")


def _packed(docs: DataFrame, width: int) -> DataFrame:
    """(rid, doc_id, text, spans) -> the packed super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows = b.slice(i, 64).to_pylist()
                out: dict[str, list] = {k: [] for k in ("mini", "doc_id", "rid", "start", "packed")}
                for r in rows:
                    w = r["text"].encode().split()
                    for s in r["spans"]:
                        out["mini"].append(s["mini"])
                        out["doc_id"].append(r["doc_id"])
                        out["rid"].append(r["rid"])
                        out["start"].append(s["start"])
                        out["packed"].append(b" ".join(w[s["start"] : s["start"] + s["n"] + width - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(out["mini"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["rid"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["packed"], pa.binary())], names=list(out))

    return docs.select("doc_id", "rid", "text", "spans").mapInArrow(run, "mini long, doc_id long, rid long, start int, packed binary")


def _windows(packed: bytes, width: int) -> list[bytes]:
    at, ends = [0], []
    for w in packed.split(b" "):
        ends.append(at[-1] + len(w))
        at.append(ends[-1] + 1)
    return [packed[at[i] : ends[i + width - 1]] for i in range(len(ends) - width + 1)]


def _repeats(rows: list[tuple[int, int, int, bytes]], width: int) -> list[tuple[int, int, int]]:
    """Of one bucket's (doc_id, rid, start, packed): (rid, start, n) of the windows that a smaller doc_id has."""
    if len({r[0] for r in rows}) < 2:
        return []
    entries = sorted((w, rows[k][0], k, i) for k in range(len(rows)) for i, w in enumerate(_windows(rows[k][3], width)))
    found: dict[int, list[int]] = {}
    last, first = None, None
    for w, doc, k, i in entries:
        if w != last:
            last, first = w, doc
        elif doc > first:
            found.setdefault(k, []).append(i)
    out = []
    for k, at in found.items():
        _, rid, start, _ = rows[k]
        at.sort()
        lo = hi = at[0]
        for i in at[1:] + [None]:
            if i is None or i != hi + 1:
                out.append((rid, start + lo, hi - lo + 1))
                lo = i
            hi = i
    return out


def _bucket_pass(packed: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["rid", "start", "n"])

        for b in batches:
            for mini, *row in zip(*(b.column(k).to_pylist() for k in ("mini", "doc_id", "rid", "start", "packed")), strict=True):
                if mini != now:
                    out += _repeats(rows, width)
                    now, rows = mini, []
                    if len(out) > 20_000:
                        yield batch()
                rows.append(tuple(row))
        out += _repeats(rows, width)
        yield batch()

    return packed.mapInArrow(run, "rid long, start int, n int")


def _window_digests(packed: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(0, b.num_rows, 512):
                digest, take, start = [], [], []
                part = b.slice(r, 512)
                for k, (p, s) in enumerate(zip(part.column("packed").to_pylist(), part.column("start").to_pylist(), strict=True)):
                    d = [hashlib.md5(w).digest() for w in _windows(p, width)]
                    digest += d
                    take += [k] * len(d)
                    start += range(s, s + len(d))
                t = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), part.column("doc_id").take(t), part.column("rid").take(t), pa.array(start, pa.int32())], names=["digest", "doc_id", "rid", "start"])

    return packed.select("doc_id", "rid", "start", "packed").mapInArrow(run, "digest binary, doc_id long, rid long, start int")


def repeated_windows(texts: DataFrame, width: int = 50, inner: int = 24, hot: int = 2000) -> DataFrame:
    """(rid, doc_id, text) -> (rid, marks) for the rows that hold windows which a row with a smaller doc_id has too.

    texts: rid is unique, so joins on it move no text where texts is bucketed by it. marks:
    array of (start, n), n consecutive windows from word `start`; a copy of a whole text
    with a smaller id has the mark (0, all). Rows with a null id take no part. Copies are
    recognised by a 128-bit digest; repeated rows of one id share one result.
    """
    texts = texts.where("doc_id IS NOT NULL")
    keys = materialise(texts.select("rid", "doc_id", F.unhex(F.md5("text")).alias("digest")), "keys")
    # of each text the row with the smallest id speaks for all
    firsts = materialise(keys.groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("f")).select("digest", F.col("f.doc_id").alias("first"), F.col("f.rid").alias("own")), "firsts")
    spans = materialise(_spans(texts.join(firsts.select(F.col("own").alias("rid")), "rid", "left_semi"), width, inner), "spans")
    # only minimisers of at least two different texts can lead to an earlier document's window
    shared = spans.groupBy("mini").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a <> b").select("mini")
    live = spans.join(shared, "mini").groupBy("rid").agg(F.collect_list(F.struct("mini", "start", "n")).alias("spans"))
    packed = materialise(_packed(texts.join(live, "rid"), width), "packed")
    discard(spans)
    big = materialise(packed.groupBy("mini").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("mini", F.lit(True).alias("big")), "hot")
    told = packed.join(big, "mini", "left")
    cold = told.where("big IS NULL").drop("big").repartition(partitions(texts.sparkSession) * 2, "mini").sortWithinPartitions("mini")
    marks = _bucket_pass(cold, width)
    single = materialise(_window_digests(told.where("big"), width), "windows")
    first = single.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    marks = marks.unionByName(single.join(first, "digest").where("first < doc_id").select("rid", "start", F.lit(1).alias("n")))
    marks = materialise(marks.groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("marks")), "marks")
    rest = keys.join(firsts, "digest").where("rid <> own")
    copies = rest.where("doc_id > first").select("rid", F.array(F.struct(F.lit(0).alias("start"), F.lit(2**30).alias("n"))).alias("marks"))
    twins = rest.where("doc_id = first").select(F.col("rid").alias("twin"), F.col("own").alias("rid")).join(marks, "rid").select(F.col("twin").alias("rid"), "marks")
    out = materialise(marks.unionByName(copies).unionByName(twins), "marks")
    for x in (packed, big, single, firsts, keys, marks):
        discard(x)
    return out


def _cut(width: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(text: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for t, m in zip(text, marks, strict=True):
            w = (t.as_py() or "").encode().split()
            n = len(w)
            if m.is_valid and n >= width:
                gone = np.zeros(n + 1, np.int64)
                for s in m.as_py():
                    gone[s["start"]] += 1
                    gone[min(s["start"] + s["n"] + width - 1, n)] -= 1
                keep = (np.cumsum(gone[:-1]) == 0).tolist()
                w = [x for x, k in zip(w, keep, strict=True) if k]
            out.append({"n_words": n, "n_removed": n - len(w), "kept": b" ".join(w).decode()})
        return pa.array(out, kind)

    return F.arrow_udf(cut, "struct<n_words:long,n_removed:long,kept:string>")


def remove_repeats(docs: DataFrame, width: int = 50, inner: int = 24, hot: int = 2000, id_col: str = "doc_id", text_col: str = "text", out_col: str = "cut") -> DataFrame:
    """docs with a struct column out_col: n_words, n_removed and kept, the remaining words joined by one space.

    A word goes if a window that covers it also starts in a document with a smaller id.
    A null text has no words; a text of fewer than `width` words keeps all; rows with a
    null id keep all and remove nothing elsewhere; repeated rows of one id keep alike, as
    only a smaller id removes; an empty table gives no rows. Windows are judged on the input.
    out_col must not be a column of docs. The rows are kept in a bucketed table of the
    warehouse, which the result reads.
    """
    spark = docs.sparkSession
    name = f"loomfeed_rows_{uuid.uuid4().hex}"
    parts = partitions(spark)
    # rows are dealt out by a unique number once; what follows moves numbers and packed strings only
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows.repartition(parts, "rid").write.bucketBy(parts, "rid").option("compression", "zstd").saveAsTable(name)
    rows = spark.table(name)
    texts = rows.select("rid", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"))
    marks = repeated_windows(texts, width, inner, hot)
    out = rows.join(marks, "rid", "left").select("row.*", _cut(width)(F.col(f"row.`{text_col}`"), F.col("marks")).alias(out_col))
    return out
