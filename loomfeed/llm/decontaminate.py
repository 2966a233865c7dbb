"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments, each of some megabytes of whole documents: the segment's
distinct words and, word by word, the ascending list of places where it stands (its
postings; places count the words of the whole segment). It is written once and serves any
number of searches. A search goes through the segments where they lie: for every window of
benchmark words it starts from the list of the word that is rarest in the segment, shifts
each list by the word's offset in the window and keeps the places that all lists share.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, trim

#: A-Z in lower case; digits, letters and all bytes of other characters stay; the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPANS = "array<struct<start:int,end:int>>"
_RESULT = f"n_words long, n_hit long, spans {SPANS}, items array<string>, near_spans {SPANS}, near_items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _by_term(ids: np.ndarray, n: int) -> np.ndarray:
    """Places in the order of their term, ascending within a term: a radix sort by halves."""
    order = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")
    if n > 1 << 16:
        order = order[np.argsort((ids[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 8 << 20) -> DataFrame:
    """One row per segment: segment, ids and sizes of its documents, terms, starts of their lists, postings.

    terms: the words, each once, parted by spaces; starts: the bounds of their lists and
    postings: places from 0, both unsigned 32-bit integers. A null text has no words; a
    document lies in one segment whatever its length; an empty table has no segments.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"segment long, ids array<{kind}>, sizes binary, terms binary, starts binary, postings binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            vocabulary: dict = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            return vocabulary, [], [], []

        number, at, id_type = TaskContext.get().partitionId() << 32, 0, None
        vocabulary, ids, places, sizes = fresh()

        def segment() -> pa.RecordBatch:
            term = np.concatenate(places) if places else np.zeros(0, np.uint32)
            n = len(vocabulary)
            starts = np.zeros(n + 1, np.uint32)
            np.cumsum(np.bincount(term, minlength=n), out=starts[1:])
            columns = [np.array(sizes, np.uint32).tobytes(), b" ".join(vocabulary), starts.tobytes(), _by_term(term, n).astype(np.uint32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), *(pa.array([c], pa.binary()) for c in columns)], names=["segment", "ids", "sizes", "terms", "starts", "postings"])

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or b""
                term = np.fromiter(map(vocabulary.__getitem__, words(t)), np.uint32)
                ids.append(i)
                places.append(term)
                sizes.append(len(term))
                at += len(t) + 16
                if at >= segment_bytes:
                    yield segment()
                    number, at = number + 1, 0
                    vocabulary, ids, places, sizes = fresh()
        if ids:
            yield segment()
        del vocabulary, ids, places, sizes
        trim()

    return materialise(docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema), "postings")


class Windows:
    """The distinct windows of some items, by length: rows of term numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str | None]] = {}
        for name, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words(text)]
            for k in range(max(len(w) - size, 0) + 1 if w else 0):
                holders.setdefault(tuple(w[k : k + size]), set()).add(name)
        self.lengths = []
        for n in sorted({len(w) for w in holders}):
            rows = [w for w in holders if len(w) == n]
            self.lengths.append((np.array(rows, np.int64), [holders[w] for w in rows]))


def _matches(rows: np.ndarray, keys: np.ndarray, counts: np.ndarray, first: np.ndarray, width: int, bounds: np.ndarray, slop: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first place, last place) of the matches of windows of one length in a segment.

    keys: term * width + place of all postings, ascending; counts and first: by term the
    size and begin of its list. A match with slop s takes a place for every word of the
    window, in one document, so that place minus offset lie within s of each other; at 0 it
    is the phrase. Works on `most` candidates at a time.
    """
    have = counts[rows]
    alive = np.flatnonzero(have.min(axis=1) > 0)
    if not len(alive):
        return
    order = np.argsort(have[alive], axis=1, kind="stable")
    rarest = np.take_along_axis(rows[alive], order[:, :1], axis=1)[:, 0]
    load = counts[rarest]
    cuts = np.searchsorted(np.cumsum(load), np.arange(most, load.sum() + most, most))
    lo = 0
    for hi in [*(cuts + 1), len(alive)]:
        hi = min(hi, len(alive))
        if hi <= lo:
            continue
        n = load[lo:hi]
        w = np.repeat(np.arange(lo, hi), n)
        place = keys[first[rarest[w]] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)] % width
        doc = np.searchsorted(bounds, place, side="right") - 1
        for shift in range(slop + 1):
            at, begin, end = w, bounds[doc], bounds[doc + 1] - 1
            base = place - order[w, 0] - shift
            low, high = place, place
            for k in range(1, rows.shape[1]):
                offset = order[at, k]
                term = rows[alive[at], offset]
                least = np.maximum(base + offset, begin)
                found = keys[np.minimum(np.searchsorted(keys, term * width + least), len(keys) - 1)]
                ok = (least <= end) & (found >= term * width + least) & (found <= term * width + np.minimum(base + offset + slop, end))
                found = found % width
                at, begin, end, base, low, high = at[ok], begin[ok], end[ok], base[ok], np.minimum(low, found)[ok], np.maximum(high, found)[ok]
                if not len(at):
                    break
            if len(at):
                yield alive[at], low, high
        lo = hi


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end) in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _search_segment(seg: dict, windows: Windows, slop: int) -> list[tuple]:
    """(n_words, n_hit, spans, items, near spans, near items) of each document of a segment."""
    sizes, starts = np.frombuffer(seg["sizes"], np.uint32).astype(np.int64), np.frombuffer(seg["starts"], np.uint32).astype(np.int64)
    postings = np.frombuffer(seg["postings"], np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    width, n = max(int(bounds[-1]), 1), len(windows.vocabulary)
    mine = windows.vocabulary
    local = np.full(n, -1, np.int64)
    for i, w in enumerate(seg["terms"].split(b" ")):
        if w in mine:
            local[mine[w]] = i
    counts = np.where(local >= 0, starts[local + 1] - starts[local], 0) if len(starts) > 1 else np.zeros(n, np.int64)
    first = np.cumsum(counts) - counts
    keys = np.concatenate([t * width + postings[starts[i] : starts[i + 1]].astype(np.int64) for t, i in enumerate(local) if i >= 0] or [np.zeros(0, np.int64)])
    out = []
    for within in dict.fromkeys((0, slop)):
        spans: dict[int, list] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        for rows, holders in windows.lengths:
            for row, low, high in _matches(rows, keys, counts, first, width, bounds, within):
                doc = np.searchsorted(bounds, low, side="right") - 1
                for d, r in {*zip(doc.tolist(), row.tolist(), strict=True)}:
                    items[d] |= holders[r]
                a = np.unique(np.stack([doc, low - bounds[doc], high - bounds[doc] + 1], axis=1), axis=0)
                for d, x, y in a.tolist():
                    spans[d].append((x, y))
        out.append(({d: _merged(s) for d, s in spans.items()}, {d: sorted(x - {None}) for d, x in items.items()}))
    (spans, items), (near, near_items) = out[0], out[-1]
    return [(size, sum(b - a for a, b in spans.get(d, ())), spans.get(d, []), items.get(d, []), near.get(d, []), near_items.get(d, [])) for d, size in enumerate(sizes.tolist())]


def _search(index: DataFrame, items: list[tuple[str | None, bytes]], size: int, slop: int) -> DataFrame:
    spark, kind = index.sparkSession, index.schema["ids"].dataType.elementType.simpleString()
    sent = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, span = Windows(sent.value, size), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for k in range(b.num_rows):
                seg = {c: b.column(c)[k].as_py() for c in ("segment", "sizes", "terms", "starts", "postings")}
                ids = b.column("ids")[k].values
                found = list(zip(*_search_segment(seg, windows, slop), strict=True))
                spans = [pa.array([[{"start": x, "end": y} for x, y in d] for d in found[c]], span) for c in (2, 4)]
                names = [pa.array(found[c], pa.list_(pa.string())) for c in (3, 5)]
                yield pa.RecordBatch.from_arrays([pa.array([seg["segment"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64()), ids, pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), spans[0], names[0], spans[1], names[1]], names=["segment", "place", "doc_id", "n_words", "n_hit", "spans", "items", "near_spans", "near_items"])
        trim()

    return index.mapInArrow(run, f"segment long, place long, doc_id {kind}, {_RESULT}")


def _joined(parts: DataFrame) -> DataFrame:
    """The results of several searches as one row per document."""
    lists = ["spans", "items", "near_spans", "near_items"]
    whole = parts.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in lists])
    sorted_spans = [F.array_sort(c).alias(c) for c in ("spans", "near_spans")]
    whole = whole.select("segment", "place", "doc_id", "n_words", *sorted_spans, *[F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")])

    def merged(c: str):
        last = lambda acc: F.element_at(acc, -1)
        widened = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
        return F.aggregate(c, F.array().cast(SPANS), lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), widened(acc, s)).otherwise(F.concat(acc, F.array(s)))).alias(c)

    whole = whole.withColumns({c: merged(c) for c in ("spans", "near_spans")})
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return whole.withColumn("n_hit", hit)


def find(index: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, item_col: str = "item_id", text_col: str = "text", chunk_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, near_spans, near_items of every document of an index.

    A window is `size` consecutive words of an item; an item of fewer words, but not none,
    is one window. spans: the runs of words [start, end) of the document inside exact
    occurrences of windows, merged; items: the ids, as strings, of items with such windows,
    in order. near_*: the same for proximity matches, whose words may each be shifted so
    that they stray by `slop` places from the phrase; with slop 0 they equal the others.
    Items with a null or repeated id count as one each by id; windows of a null id are hit
    but not listed; null and wordless texts have no windows. The windows are sent to the
    index, of `chunk_bytes` of item texts at a time: more items take more passes.
    """
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    chunks = -(-total // chunk_bytes) or 1
    found = None
    for k in range(chunks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == k) if chunks > 1 else rows
        one = _search(index, [(r.item, bytes(r.text)) for r in part.collect()], size, slop)  # some chunk_bytes
        found = one if found is None else found.unionByName(one)
    if chunks > 1:
        found = _joined(found)
    return found.select("doc_id", "n_words", "n_hit", "spans", "items", "near_spans", "near_items")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 8 << 20) -> DataFrame:
    """find() over an index of docs, one row for every row of docs.

    Null texts have no words and are clean; null ids and repeated rows keep a row each;
    empty tables on either side give no rows and no hits; other columns are ignored.
    """
    return find(build_index(docs, id_col, text_col, segment_bytes), items, size, slop)


def oracle_sql() -> str:
    """The digest of the query in SQL."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id, {words} AS w FROM benchmark),
    v AS (SELECT DISTINCT item_id, len(w[k:k + 9]) AS l, array_to_string(w[k:k + 9], ' ') AS x
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
    p AS (SELECT r, k, l, array_to_string(w[k:k + l - 1], ' ') AS x
          FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT l FROM v))),
    m AS (SELECT r, k, p.l, item_id FROM p JOIN v ON p.l = v.l AND p.x = v.x),
    h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS k FROM (SELECT DISTINCT r, k, l FROM m)) GROUP BY r),
    i AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""
