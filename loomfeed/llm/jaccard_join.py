"""Similarity classes of documents by the Jaccard similarity of their word n-grams.

The global order puts n-grams by document frequency, ties by hash. Documents are dealt
into blocks of bounded size; a block sends its distinct n-grams once, packed by hash range,
each range sums them over all blocks, and the frequencies travel back. An n-gram of one set
only is in no overlap, so it takes its place in the order but moves no further. Two sets
that link share an n-gram of their prefixes in that order. The order is cut into fragments
at fixed frequencies; for every candidate pair the overlaps are counted per fragment and
summed, which is exact. Equal sets are one class and compared once; classes that verified
links already join are not paired again, as the result needs connected components only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordnp
from .common import connected_components, discard, materialise, partitions

#: Document frequencies at which the second and later fragments of the order begin.
PIVOTS = (3, 8, 64)
_KEY = np.uint64(16)  # the top 48 bits of a hash name an n-gram where frequencies are counted; those of two that share them add up
_SEGMENT = "cid long, n int, frag int, first int, grams array<long>, shared double, s0 long, s1 long, sketch binary"
#: n-grams before a posting that it carries: two sets that have one of them in common meet in an earlier list.
BEFORE = 4


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, values, bounds): each text's distinct n-gram hashes, sorted.

    A text with fewer than n words, but at least one, has its whole sequence as its only
    n-gram; one without words has none.
    """
    for lo, hi, data, off in wordnp.slices(column):
        data = wordnp.lowered(data)
        starts, ends, bounds = wordnp.words(data, off)
        h = wordnp.hashes(data, starts, ends)
        g = wordnp.grams(h, n)
        count = np.diff(bounds)
        own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        text = np.repeat(np.arange(len(own)), own)
        at = np.arange(len(text)) - (np.cumsum(own) - own)[text]
        values = np.empty(len(text), np.uint64)
        short = count[text] < n
        values[~short] = g[bounds[:-1][text[~short]] + at[~short]]
        if short.any():
            values[short] = wordnp.sequences(h, bounds)[text[short]]
        ends = np.cumsum(own).tolist()
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            values[a:b].sort()
        keep = np.ones(len(text), bool)
        keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        values, text = values[keep], text[keep]
        yield lo, hi, values, np.searchsorted(text, np.arange(hi - lo + 1))


def _profiles(texts: DataFrame, n: int) -> DataFrame:
    """(rid, doc_id, text) -> rid, doc_id, size of its set, digest of the set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, values, bounds in shingle_sets(b.column(2), n):
                digest = [hashlib.md5(values[x:y].tobytes()).digest() if x < y else None for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds).astype(np.int64)), pa.array(digest, pa.binary())], names=["rid", "doc_id", "n", "digest"])

    return texts.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n long, digest binary")


def _pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted ids as compressed differences, and their counts."""
    delta = np.diff(ids, prepend=np.uint64(0))
    planes = delta.view(np.uint8).reshape(-1, 8).T
    raw = np.uint64(len(ids)).tobytes() + planes.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.uint64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(packed[8:], decompressed_size=int(np.frombuffer(packed[:8], np.uint64)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], np.uint64)[0])
    delta = np.frombuffer(raw[8 : 8 + 8 * n], np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel()
    counts = np.frombuffer(raw[8 + 8 * n :], np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel()
    return np.cumsum(delta, dtype=np.uint64), counts


def _sets(texts: pa.Table, own: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts whose rid is in own: rids, sizes, all values, the text of each value, and the sorted distinct keys of the values."""
    t = texts.filter(pc.is_in(texts.column("rid"), own))
    parts = list(shingle_sets(t.column("text"), n))
    size = np.concatenate([np.diff(p[3]) for p in parts]) if parts else np.zeros(0, np.int64)
    values = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64)
    return t.column("rid").to_numpy(), size, values, np.repeat(np.arange(len(size)), size), np.unique(values >> _KEY)


def _requests(texts: DataFrame, classes: DataFrame, n: int, parts: int) -> DataFrame:
    """(block, part, packed): for each block and hash range the distinct keys of its sets, and in how many of them each is."""

    def run(left, right):
        _, _, values, _, keys = _sets(left, right.column("cid").combine_chunks(), n)
        counts = np.bincount(np.searchsorted(keys, values >> _KEY), minlength=len(keys))
        cut = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.float64) / parts * 2.0**48).astype(np.uint64))
        at = np.flatnonzero(cut[1:] > cut[:-1])
        packed = [_pack(keys[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]) for k in at]
        block = left.column("block")[0].as_py() if left.num_rows else 0
        return pa.table({"block": pa.array([block] * len(at), pa.int32()), "part": pa.array(at, pa.int32()), "packed": pa.array(packed, pa.binary())})

    return texts.select("block", "rid", "text").groupBy("block").cogroup(classes.select("block", "cid").groupBy("block")).applyInArrow(run, "block int, part int, packed binary")


def frequency_level(df: np.ndarray) -> np.ndarray:
    """A byte that does not fall as the frequency grows; 0 for 1, one step for each frequency to 129, then eight for each doubling."""
    high = 128 + np.floor(8 * np.log2(np.maximum(df, 129) / 129))
    return np.where(df <= 129, df - 1, np.minimum(high, 255)).astype(np.uint8)


def _levels(requests: DataFrame) -> DataFrame:
    """(block, part, levels): the level of each key of a request, in its order."""

    def run(key, t):
        got = [_unpack(x) for x in t.column("packed").to_pylist()]
        keys, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        level = frequency_level(np.bincount(at, np.concatenate([g[1] for g in got]).astype(np.float64), len(keys)))[at]
        ends = np.cumsum([len(g[0]) for g in got])
        out = [pa.compress(level[e - len(g[0]) : e].tobytes(), codec="zstd", asbytes=True) for e, g in zip(ends.tolist(), got, strict=True)]
        return pa.table({"block": t.column("block"), "part": t.column("part"), "size": pa.array(np.diff(ends, prepend=0), pa.int32()), "levels": pa.array(out, pa.binary())})

    return requests.groupBy("part").applyInArrow(run, "block int, part int, size int, levels binary")


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first n-grams of a set of n must be looked at so that no link is missed."""
    return n - (percent * n + 99) // 100 + 1


def _sketch(v: np.ndarray) -> bytes:
    """A bit for each of at least 4n bins, set if an odd number of values falls in it."""
    bits = max(6, (4 * len(v) - 1).bit_length())
    odd = np.bincount((v >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def _segments(texts: DataFrame, classes: DataFrame, levels: DataFrame, n: int, percent: int) -> DataFrame:
    """The n-grams of each set that other sets hold, cut along the global order.

    One row per set and fragment: the n-grams in order and the place of the first. Sets
    whose prefix holds only n-grams of their own are left out. The first row of a set
    carries its sketch. shared: the part of the prefix that other sets hold. s0, s1: 128 bins
    of the whole set, odd or even.
    """
    pivots = frequency_level(np.array(PIVOTS))

    def run(left, right):
        cid = right.column("cid").combine_chunks()
        rid, size, values, text, keys = _sets(left, cid.drop_null(), n)
        got = sorted((p, s, x) for p, s, x in zip(right.column("part").to_pylist(), right.column("size").to_pylist(), right.column("levels").to_pylist(), strict=True) if p is not None)
        level = np.frombuffer(b"".join(pa.decompress(x, decompressed_size=s, codec="zstd", asbytes=True) for _, s, x in got), np.uint8)
        assert len(level) == len(keys), "requests and levels of a block differ"
        level = level[np.searchsorted(keys, values >> _KEY)]
        odd = np.zeros((len(size), 128), np.uint8)
        np.add.at(odd, (text, (values & np.uint64(127)).astype(np.int64)), 1)
        bins = np.packbits(odd & 1, axis=1).view(np.int64)
        begin = np.cumsum(size) - size
        sketch = {}
        order = np.lexsort((values, level, text))
        g, lv = values[order], level[order]
        pos = np.arange(len(g)) - begin[text]
        live = np.bincount(text[(lv > 0) & (pos < prefix_size(size, percent)[text])], minlength=len(size))
        shared = live / np.maximum(prefix_size(size, percent), 1)
        for i in np.flatnonzero(live).tolist():
            sketch[i] = _sketch(values[begin[i] : begin[i] + size[i]])
        keep = (lv > 0) & (live[text] > 0)
        g, tx, pos, frag = g[keep], text[keep], pos[keep], np.searchsorted(pivots, lv[keep], "right")
        new = np.flatnonzero(np.append(True, (tx[1:] != tx[:-1]) | (frag[1:] != frag[:-1]))) if len(g) else np.zeros(0, np.int64)
        grams = pa.ListArray.from_arrays(pa.array(np.append(new, len(g)).astype(np.int32)), pa.array(g.view(np.int64)))
        of = tx[new]
        first = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
        marks = [sketch[i] if f else None for i, f in zip(of.tolist(), first.tolist(), strict=True)]
        cols = [rid[of], size[of].astype(np.int32), frag[new].astype(np.int32), pos[new].astype(np.int32), grams, shared[of], bins[of, 0], bins[of, 1], pa.array(marks, pa.binary())]
        return pa.table(dict(zip(("cid", "n", "frag", "first", "grams", "shared", "s0", "s1", "sketch"), map(pa.array, cols), strict=True)))

    info = classes.select("block", "cid", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("binary").alias("levels"))
    info = info.unionByName(levels.select("block", F.lit(None).cast("long").alias("cid"), "part", "size", "levels"))
    return texts.select("block", "rid", "text").groupBy("block").cogroup(info.groupBy("block")).applyInArrow(run, _SEGMENT)


def _postings(segments: DataFrame, percent: int) -> DataFrame:
    """(gram, cid, n, pos, shared, s0, s1, b0 ...) of the n-grams in the prefixes that other sets hold; b: the ones before in the fragment, or 0."""
    s = segments.withColumn("left", F.expr(f"n - (({percent}L * n + 99) div 100) + 1 - first")).where("left > 0")
    s = s.withColumn("grams", F.slice("grams", F.lit(1), F.col("left").cast("int")))
    s = s.select("cid", "n", "first", "shared", "s0", "s1", "grams", F.posexplode("grams").alias("i", "gram"))
    before = [F.coalesce(F.get("grams", F.col("i") - (k + 1)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(BEFORE)]
    return s.select("gram", "cid", "n", (F.col("first") + F.col("i")).alias("pos"), "shared", "s0", "s1", *before)


_COLUMNS = ["cid", "comp", "n", "pos", "s0", "s1", *[f"b{k}" for k in range(BEFORE)]]


def _group_pairs(x: np.ndarray, percent: int, half: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Pairs of one posting list that may link: of different components, not met in a list before; sizes, positions and bins allow enough overlap. Rows of x: _COLUMNS."""
    order = np.argsort(x[2], kind="stable")
    x = x[:, order]
    (doc, comp, n, pos, s0, s1), before = x[:6], x[6:]
    half = half[order] if half is not None else None
    end = np.searchsorted(n, 100 * n // percent, "right")
    out = [[], [], [], []]
    for i in range(len(doc) - 1):
        j = slice(i + 1, end[i])
        least = -(-percent * (n[i] + n[j]) // (100 + percent))
        ok = (comp[j] != comp[i]) & (np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least)
        bins = np.bitwise_count((s0[j] ^ s0[i]).view(np.uint64)).astype(np.int64) + np.bitwise_count((s1[j] ^ s1[i]).view(np.uint64))
        ok &= bins <= n[i] + n[j] - 2 * least
        if half is not None:
            ok &= half[j] != half[i]
        k = np.flatnonzero(ok) + i + 1
        for g in before[:, i]:
            if g and len(k):
                k = k[(before[:, k] != g).all(axis=0)]
        if len(k):
            for y, z in zip(out, (np.minimum(doc[i], doc[k]), np.maximum(doc[i], doc[k]), np.where(doc[i] < doc[k], n[i], n[k]), np.where(doc[i] < doc[k], n[k], n[i])), strict=True):
                y.append(z)
    return tuple(np.concatenate(y) if y else np.zeros(0, np.int64) for y in out)


def _list_pairs(postings: DataFrame, percent: int, hot: int) -> DataFrame:
    """Postings sorted by gram -> candidate pairs; lists of more than `hot` rows come out as rows (b is null)."""
    names = ["a", "b", "na", "nb", "gram", *_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spilling = None, None

        def batch(head: list, tail: list) -> pa.RecordBatch:
            k = max(map(len, (head or tail)))
            fill = [pa.nulls(k, pa.int64())]
            return pa.RecordBatch.from_arrays([*map(pa.array, head or fill * 4), *map(pa.array, tail or fill * (1 + len(_COLUMNS)))], names=names)

        def pairs(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not x.shape[1]:
                return
            at = np.flatnonzero(np.append(True, x[0][1:] != x[0][:-1]))
            size = np.diff(np.append(at, x.shape[1]))
            live = np.minimum.reduceat(x[2], at) != np.maximum.reduceat(x[2], at)
            out = []
            for s, k in zip(at[live].tolist(), size[live].tolist(), strict=True):
                if k > hot:
                    yield batch([], list(x[:, s : s + k]))
                else:
                    out.append(_group_pairs(x[1:, s : s + k], percent))
            if out and sum(len(y[0]) for y in out):
                both = np.unique(np.concatenate([np.stack(y) for y in out], axis=1), axis=1)
                yield batch(list(both), [])

        for b in batches:
            x = np.stack([b.column(k).to_numpy().astype(np.int64) for k in ("gram", *_COLUMNS)])
            x = x if held is None else np.concatenate([held, x], axis=1)
            if not x.shape[1]:
                continue
            last = x[0, -1]
            cut = int(np.searchsorted(x[0], last))
            if spilling is not None and cut:
                k = int(np.searchsorted(x[0], spilling, "right"))
                if k:
                    yield batch([], list(x[:, :k]))
                x, cut, spilling = x[:, k:], cut - k, None
            yield from pairs(x[:, :cut])
            held = x[:, cut:]
            if held.shape[1] > hot or spilling == last:
                yield batch([], list(held))
                held, spilling = held[:, :0], last
        if held is not None and held.shape[1]:
            if spilling is not None and held[0, 0] == spilling:
                yield batch([], list(held))
            else:
                yield from pairs(held)

    return postings.mapInArrow(run, ", ".join(f"{k} long" for k in names))


def _tiles(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of long posting lists: the list is dealt into blocks, each two of which meet in one task."""
    sizes = rows.groupBy("gram").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    r = rows.join(sizes, "gram").select("gram", *_COLUMNS, "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("i"))
    r = r.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("gram", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", *_COLUMNS)

    def run(key, t):
        x = np.stack([t.column(k).to_numpy() for k in _COLUMNS])
        a, b, na, nb = _group_pairs(x, percent, half=None if key[1].as_py() == key[2].as_py() else t.column("i").to_numpy())
        return pa.table({"a": a, "b": b, "na": na, "nb": nb})

    return r.groupBy("gram", "x", "y").applyInArrow(run, "a long, b long, na long, nb long")


def _fold(x: bytes, size: int) -> np.ndarray:
    """A sketch with bins joined until it has `size` bytes; bins are leading bits of the hash, so neighbours join."""
    bits = np.unpackbits(np.frombuffer(x, np.uint8))
    return np.bitwise_xor.reduce(bits.reshape(size * 8, -1), axis=1)


def _possible(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches do not rule them out: two sets differ in at least as many n-grams as their sketches in bits."""
    sketches = segments.where("sketch IS NOT NULL").select("cid", "sketch")
    both = pairs.join(sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            most = na + nb - 2 * -(-percent * (na + nb) // (100 + percent))
            keep = []
            for x, y, m in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), most.tolist(), strict=True):
                if len(x) == len(y):
                    keep.append((int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= m)
                else:
                    size = min(len(x), len(y))
                    keep.append(int((_fold(x, size) ^ _fold(y, size)).sum()) <= m)
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na long, nb long")


def verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs (a, b, na, nb) whose similarity is at least percent / 100: overlaps per fragment, summed per pair."""
    pairs = materialise(_possible(pairs, segments, percent), "possible")
    left = segments.select(F.col("cid").alias("a"), "frag", F.col("grams").alias("ga"))
    right = segments.select(F.col("cid").alias("b"), "frag", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    out = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both")).where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both")))
    out = materialise(out.select("a", "b"), "links")
    discard(pairs)
    return out


def _leaders(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each set one pair at most: with the leader of the lists that it shares the most of.

    At first a list's leader is the set that shares most of its prefix, which in a group of
    near copies is the one they come from; in later turns one drawn by hash.
    """
    rank = (-F.col("shared") if not turn else F.lit(0.0), F.xxhash64("cid", F.lit(turn)))
    lead = lists.groupBy("gram").agg(F.min(F.struct(rank[0].alias("r"), rank[1].alias("h"), "cid", "n", "pos", "s0", "s1", "comp")).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram", "l")
    least = f"(({percent}L * (n + l.n) + {99 + percent}) div {100 + percent})"
    near = lists.join(lead, "gram").where("comp <> l.comp").where(f"100L * least(n, l.n) >= {percent}L * greatest(n, l.n)")
    near = near.where(f"least(pos, l.pos) + least(n - pos, l.n - l.pos) >= {least} AND bit_count(s0 ^ l.s0) + bit_count(s1 ^ l.s1) <= n + l.n - 2 * {least}")
    near = near.groupBy("cid", "n", F.col("l.cid").alias("x"), F.col("l.n").alias("nx")).agg(F.count("*").alias("c"))
    near = near.groupBy("cid", "n").agg(F.max_by(F.struct("x", "nx"), F.struct("c", F.xxhash64("x"))).alias("l"))
    low = F.col("cid") < F.col("l.x")
    side = lambda y, z: F.when(low, F.col(y)).otherwise(F.col(z)).cast("long")
    return near.select(side("cid", "l.x").alias("a"), side("l.x", "cid").alias("b"), side("n", "l.nx").alias("na"), side("l.nx", "n").alias("nb")).distinct()


def _links(segments: DataFrame, percent: int, hot: int, turns: int = 4) -> DataFrame:
    """(u, v) that join the same sets as all links do."""
    postings = materialise(_postings(segments, percent), "postings")
    size, links, lists, comps = postings.count(), [], postings.withColumn("comp", F.col("cid")), None
    for turn in range(turns):
        pairs = materialise(_leaders(lists, percent, turn), "pairs")
        found = verified(pairs, segments, percent)
        discard(pairs)
        links.append(found)
        for x in (lists, *([comps] if comps is not None else [])):
            discard(x)
        comps = materialise(connected_components(_union([x.select(F.col("a").alias("u"), F.col("b").alias("v")) for x in links])), "comps")
        lists = materialise(postings.join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component"), "lists")
        # pairs of different components in all lists: another turn pays if they are many
        each = lists.groupBy("gram", "comp").count().groupBy("gram").agg(F.sum("count").alias("s"), F.sum(F.expr("double(count) * count")).alias("q"))
        if (each.agg(F.sum(F.expr("(double(s) * s - q) / 2"))).first()[0] or 0) <= 4 * size or found.isEmpty():
            break
    live = lists.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    rest = lists.join(live, "gram", "left_semi").select("gram", *_COLUMNS)
    found = materialise(_list_pairs(rest.repartition(partitions(postings.sparkSession), "gram").sortWithinPartitions("gram"), percent, hot), "candidates")
    pairs = found.where("b IS NOT NULL").select("a", "b", "na", "nb")
    pairs = materialise(pairs.unionByName(_tiles(found.where("b IS NULL"), percent, hot)).distinct(), "pairs")
    links.append(verified(pairs, segments, percent))
    out = materialise(_union([x.select(F.col("a").alias("u"), F.col("b").alias("v")) for x in links]), "edges")
    for x in (found, pairs, postings, lists, comps, *links):
        discard(x)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def similarity_classes(docs: DataFrame, n: int = 4, percent: int = 85, hot: int = 400, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Two documents link when 100 * |A and B| >= percent * |A or B| of their distinct n-word
    shingles (A-Z lower-cased), named by 64-bit hashes. component_id is the smallest id
    that links reach, its own included. Null and wordless texts have no shingles and link
    with nothing; rows with a null id get a null component and link with nothing; repeated
    rows give repeated results; an id with different texts takes part with each of them,
    and its rows share the component. An empty table gives no rows. Other columns are
    ignored. Posting lists of more than `hot` rows are paired in blocks of that many;
    both ways give the same pairs. A block of about `block_bytes` is one unit of work, a
    longer text is one of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks, parts = max(1, -(-n_bytes // block_bytes)), partitions(spark)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    name = f"loomfeed_texts_{uuid.uuid4().hex}"
    # all texts are dealt into blocks once; later steps move ids, requests and n-grams only
    rows.select(block("rid"), "rid", "doc_id", "text").repartition(parts, "block").write.bucketBy(parts, "block").sortBy("block").option("compression", "zstd").saveAsTable(name)
    try:
        texts = spark.table(name)
        profiles = materialise(_profiles(texts, n), "profiles")
        # equal sets are one class, named by the smallest row of it
        known = profiles.where("n > 0 AND doc_id IS NOT NULL")
        classes = materialise(known.groupBy("digest").agg(F.min("rid").alias("cid"), F.first("n").alias("n")).withColumn("block", block("cid")), "classes")
        total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        levels = materialise(_levels(_requests(texts, classes, n, max(parts, -(-total // 8_000_000)))), "levels")
        segments = materialise(_segments(texts, classes, levels, n, percent), "segments")
        discard(levels)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    edges = _links(segments, percent, hot)
    discard(segments)
    member = materialise(known.select("doc_id", "digest").join(classes.select("digest", "cid"), "digest").select("doc_id", "cid").distinct(), "members")
    several = member.groupBy("doc_id").agg(F.min("cid").alias("u"), F.max("cid").alias("v")).where("u <> v").select("doc_id", "u")
    same = member.join(several, "doc_id").where("u <> cid").select("u", F.col("cid").alias("v"))
    comps = materialise(connected_components(edges.unionByName(same)), "comps")
    discard(edges)
    found = member.join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").select("doc_id", F.coalesce("component", "cid").alias("comp")).distinct()
    low = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    result = materialise(found.join(low, "comp").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "components")
    for x in (member, comps, classes):
        discard(x)
    return profiles.join(result, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
