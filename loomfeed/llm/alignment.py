"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes. Where tokens of both end, a group ends; tokens whose
bytes overlap are linked. A text is cut at single spaces into parts that both tokenizers
encode on their own, so each distinct part is encoded and aligned once per worker. Links
are packed by block of documents and by stripe, the id of side A modulo the number of
stripes; document counts of pairs are summed in a dense matrix for each stripe, whose row
maxima tell the best partners, and links are scored where their stripe's counts are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trim

#: Fixed value: the pattern of byte-level tokenizers that cut before they merge.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Documents of a block, so that one byte names a document; most bits of a part's occurrences in a document.
DOCS, MANY = 256, 24

_pairs: dict = {}


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest unsigned type."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else np.uint8).astype(np.int64)


def _joined_ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those of first[1], and so on."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


class Pair:
    """The two tokenizers: A a byte-level one of the tokenizers library, B one of sentencepiece."""

    def __init__(self, path_a: str, path_b: str):
        import json

        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        from .packing import _rank_encoder

        tk = Tokenizer.from_file(path_a)
        tk.encode_special_tokens = True
        model = json.loads(tk.to_str())
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.n_a = max(tk.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [b""] * self.n_a
        for piece, i in tk.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(map(byte.__getitem__, piece)) if all(c in byte for c in piece) else piece.encode()
        cut = tk.normalizer is None and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and "add_prefix_space=False" in repr(tk.pre_tokenizer)
        fast = _rank_encoder(tk) if cut and public_tokenizers.PATTERN in (BYTE_LEVEL, LONG_BYTE_LEVEL) else None
        self.encode_a = (lambda t: np.frombuffer(fast(t), np.uint32)) if fast else (lambda t: np.array(tk.encode(t, add_special_tokens=False).ids, np.uint32))
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_b, bar = sp.vocab_size(), "▁"
        self.bytes_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(bar, " ").encode() for i in range(self.n_b)]
        # parts are independent if no piece goes on after a word start and texts are left as they are
        sample = "a ﬁ①Å b\tc\nd"
        self.split = cut and not any(bar in sp.id_to_piece(i).lstrip(bar) for i in range(self.n_b)) and sp.normalize(sample) == bar + sample.replace(" ", bar)
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.code = np.dtype(np.uint32 if self.n_a * self.n_b < 1 << 32 else np.int64)
        self.str_a, self.str_b = list(map(str, range(self.n_a))), list(map(str, range(self.n_b)))
        self.known: dict[str, tuple | None] = {}

    def align(self, texts: list[str]) -> list[tuple | None]:
        """(tokens of A, of B, groups, links as a * n_b + b, groups as text) of each text with a space before it; None where a tokenizer changes its bytes."""
        if not texts:
            return []
        ids_b = self.sp.encode(texts, num_threads=1)
        ids_a = [self.encode_a(" " + t) for t in texts]
        good = []
        for k, t in enumerate(texts):
            raw = (" " + t).encode()
            if b"".join(map(self.bytes_b.__getitem__, ids_b[k])) == raw and b"".join(map(self.bytes_a.__getitem__, ids_a[k].tolist())) == raw:
                good.append(k)
        out: list[tuple | None] = [None] * len(texts)
        if not good:
            return out
        count_a, count_b = np.array([len(ids_a[k]) for k in good]), np.array([len(ids_b[k]) for k in good])
        a = np.concatenate([ids_a[k] for k in good]).astype(np.int64)
        b = np.fromiter((i for k in good for i in ids_b[k]), np.int64, int(count_b.sum()))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        lo, hi = np.searchsorted(end_b, end_a - self.len_a[a], side="right"), np.searchsorted(end_b - self.len_b[b], end_a, side="left")
        links = (np.repeat(a, hi - lo) * self.n_b + b[_joined_ranges(lo, hi - lo)]).astype(self.code)
        # tokens after which a group ends, by side, and the bounds of texts among tokens, groups and links
        cut_a = np.flatnonzero(end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a) + 1
        cut_b = np.searchsorted(end_b, end_a[cut_a - 1]) + 1
        last_a = np.cumsum(count_a)
        group, link = np.searchsorted(cut_a, last_a, side="right").tolist(), np.concatenate([[0], np.cumsum(hi - lo)])[last_a].tolist()
        sa, sb = list(map(self.str_a.__getitem__, a.tolist())), list(map(self.str_b.__getitem__, b.tolist()))
        said, i, j = [], 0, 0
        for x, y in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            said.append((sa[i] if x - i == 1 else ",".join(sa[i:x])) + "|" + (sb[j] if y - j == 1 else ",".join(sb[j:y])))
            i, j = x, y
        g, n = 0, 0
        for k, na, nb, g1, n1 in zip(good, count_a.tolist(), count_b.tolist(), group, link, strict=True):
            out[k] = (na, nb, g1 - g, links[n:n1].tobytes(), ";".join(said[g:g1]))
            g, n = g1, n1
        return out

    def parts(self, texts: list[str], most: int = 300_000) -> list[tuple | None]:
        """align() for parts, remembered."""
        known = self.known
        if len(known) > most:
            known.clear()
        new = [t for t in texts if t not in known]
        for lo in range(0, len(new), 20_000):
            known.update(zip(new[lo : lo + 20_000], self.align(new[lo : lo + 20_000]), strict=True))
        return list(map(known.__getitem__, texts))


def _pair(path_a: str, path_b: str) -> Pair:
    key = (path_a, path_b)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


def _block(texts: list[str], pair: Pair, stripes: int) -> tuple[list[np.ndarray], list[str], list[tuple[int, int, bytes, bytes, bytes, bytes]]]:
    """Of a block of at most DOCS texts: token, group and link counts by text; digests; (stripe, number of codes, codes, documents of each, which, how often)."""
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    cut = [t.split(" ") if pair.split else None for t in texts]
    rows = [np.fromiter(map(number.__getitem__, p), np.int64, len(p)) if p is not None else None for p in cut]
    names = list(number)
    odd = np.array([not p or p[0].isspace() or p[-1].isspace() for p in names], bool)
    whole = [k for k, r in enumerate(rows) if r is None or odd[r].any()]
    entries = [None if o else e for o, e in zip(odd.tolist(), _fill(pair, names, odd), strict=True)]
    for k in whole:
        rows[k] = np.array([len(entries)])
        entries += pair.align([texts[k]]) if texts[k] else [None]
    size = np.array([(e[0], e[1], e[2], len(e[3]) // pair.code.itemsize) if e else (0, 0, 0, 0) for e in entries], np.int64).reshape(-1, 4)
    bad = np.array([e is None for e in entries], bool)
    rows = [r if not bad[r].any() else r[:0] for r in rows]
    place, part = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    sums = [np.zeros(len(rows), np.int64) for _ in range(4)]
    for total, s in zip(sums, size.T, strict=True):
        np.add.at(total, place, s[part])
    said = [e[4] if e else "" for e in entries]
    digests = [hashlib.sha256(";".join(map(said.__getitem__, r.tolist())).encode()).hexdigest() if len(r) else "" for r in rows]
    key, times = np.unique(place * len(entries) + part, return_counts=True)
    area = -(-pair.n_a // stripes) * pair.n_b
    bits = min(MANY, 62 - (stripes * area * DOCS).bit_length())  # what a sort key has left; no two vocabularies in use leave less than ten
    if times.max(initial=0) >> bits:  # as several entries
        n = (times >> bits) + 1
        key, share = np.repeat(key, n), np.repeat(times // n, n)
        share[np.cumsum(n) - 1] += times % n
        times = share
    place, part = key // len(entries), key % len(entries)
    held = np.frombuffer(b"".join(e[3] if e else b"" for e in entries), pair.code).astype(np.int64)
    n = size[part, 3]
    code = held[_joined_ranges((np.cumsum(size[:, 3]) - size[:, 3])[part], n)]
    a, b = code // pair.n_b, code % pair.n_b
    code = (a % stripes) * area + a // stripes * pair.n_b + b
    whole_key = np.sort((code * DOCS + np.repeat(place, n)) << bits | np.repeat(times, n))
    key = whole_key >> bits
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(first):
        return sums, digests, []
    times, key = np.add.reduceat(whole_key & (1 << bits) - 1, first), key[first]
    place, code = key % DOCS, key // DOCS
    first = np.flatnonzero(np.diff(code, prepend=-1))
    held_by, code = np.diff(first, append=len(key)), code[first]
    out, bounds = [], np.searchsorted(code, np.arange(stripes + 1) * area)
    first = np.append(first, len(key))
    for s in range(stripes):
        lo, hi = bounds[s], bounds[s + 1]
        if hi > lo:
            x, y = first[lo], first[hi]
            out.append((s, int(hi - lo), pack(np.diff(code[lo:hi] - s * area, prepend=0)), pack(held_by[lo:hi]), place[x:y].astype(np.uint8).tobytes(), pack(times[x:y])))
    return sums, digests, out


def _fill(pair: Pair, names: list[str], odd: np.ndarray) -> list[tuple | None]:
    """Entries of the parts in order; None for those that are not encoded on their own."""
    got = iter(pair.parts([p for p, o in zip(names, odd.tolist(), strict=True) if not o]))
    return [None if o else next(got) for o in odd.tolist()]


def stripes_of(pair: Pair, stripe_bytes: int) -> int:
    return max(1, -(-pair.n_a * pair.n_b * 8 // stripe_bytes))


_LINKS = "stripe int, size int, codes binary, holders binary, places binary, times binary"


def encode_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 128 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """A row per document (stripe -1: block, place, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) and a row per block and stripe with its packed links."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, place int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {_LINKS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        stripes, block = stripes_of(pair, stripe_bytes), TaskContext.get().partitionId() << 32
        names = [c.strip().split(" ")[0] for c in schema.split(",")]

        def packed(number: int, ids: list, texts: list[str], id_type) -> Iterator[pa.RecordBatch]:
            sums, digests, links = _block(texts, pair, stripes)
            n, m = len(ids), len(links)
            none = [pa.nulls(n, pa.binary())] * 4
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, id_type), *(pa.array(s) for s in sums), pa.array(digests), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.int32()), *none], names=names)
            if m:
                cols = list(zip(*links, strict=True))
                none = [pa.nulls(m, t) for t in (pa.int32(), id_type, *[pa.int64()] * 4, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([number] * m, pa.int64()), *none, *(pa.array(c, pa.int32()) for c in cols[:2]), *(pa.array(c, pa.binary()) for c in cols[2:])], names=names)

        ids, texts, size, id_type = [], [], 0, None
        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if len(ids) == DOCS or size >= block_bytes:
                    yield from packed(block, ids, texts, id_type)
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield from packed(block, ids, texts, id_type)
        pair.known.clear()
        trim()

    return materialise(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema), "links")


def _summed(rows: DataFrame, keys: list[str], path_a: str, path_b: str, stripe_bytes: int) -> DataFrame:
    """stripe, size, codes, holders, best of each group of rows (stripe, size, codes, holders) by keys: sums in a dense matrix, and whether a sum is its row's maximum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        height = -(-pair.n_a // stripes_of(pair, stripe_bytes))
        matrix, at = np.zeros(height * pair.n_b, np.int64), None

        def summed() -> pa.RecordBatch:
            code = np.flatnonzero(matrix)
            n = matrix[code]
            best = n == matrix.reshape(height, pair.n_b).max(axis=1)[code // pair.n_b]
            matrix[code] = 0
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([len(code)], pa.int32()), *(pa.array([x], pa.binary()) for x in (pack(np.diff(code, prepend=0)), pack(n), pack(best)))], names=["stripe", "size", "codes", "holders", "best"])

        for b in batches:
            of = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            for k, key in enumerate(of):
                if key != at:
                    if at is not None:
                        yield summed()
                    at = key
                codes, n = _codes(b, k)
                np.add.at(matrix, codes, n)
        if at is not None:
            yield summed()
        del matrix
        trim()

    dealt = rows.select(*keys, "size", "codes", "holders").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "stripe int, size int, codes binary, holders binary, best binary")


def _codes(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a packed row and the numbers of their holders."""
    n = b.column("size")[k].as_py()
    return np.cumsum(unpack(b.column("codes")[k].as_py(), n)), unpack(b.column("holders")[k].as_py(), n)


def _scored(links: DataFrame, counts: DataFrame) -> DataFrame:
    """block, n_best, count_sum of each row of links, as one number for each of DOCS places: links meet their stripe's counts in one task, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have, count, best = None, None, None, None
        for b in batches:
            block, sums = [], ([], [])
            for k, (stripe, of) in enumerate(zip(b.column("stripe").to_pylist(), b.column("block").to_pylist(), strict=True)):
                codes, holders = _codes(b, k)
                if of is None:  # counts come first
                    at, have, count, best = stripe, codes, holders, unpack(b.column("best")[k].as_py(), len(codes))
                    continue
                if at != stripe:
                    raise RuntimeError(f"no counts of stripe {stripe}")
                place = np.frombuffer(b.column("places")[k].as_py(), np.uint8)
                times = unpack(b.column("times")[k].as_py(), len(place))
                found = np.searchsorted(have, codes)
                block.append(of)
                for out, value in zip(sums, (best, count), strict=True):
                    total = np.zeros(DOCS, np.int64)
                    np.add.at(total, place, times * np.repeat(value[found], holders))
                    out.append(pack(total))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(pa.array(s, pa.binary()) for s in sums)], names=["block", "n_best", "count_sum"])
        trim()

    both = links.unionByName(counts, allowMissingColumns=True)
    return both.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_first("block")).mapInArrow(run, "block long, n_best binary, count_sum binary")


def _by_document(scored: DataFrame) -> DataFrame:
    """block, place, n_best, count_sum, summed over stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros((2, DOCS), np.int64)

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at] * DOCS, pa.int64()), pa.array(range(DOCS), pa.int32()), *map(pa.array, sums)], names=["block", "place", "n_best", "count_sum"])

        for b in batches:
            for of, *both in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if of != at:
                    if at is not None:
                        yield summed()
                    at, sums = of, np.zeros((2, DOCS), np.int64)
                sums += np.stack([unpack(x, DOCS) for x in both])
        if at is not None:
            yield summed()

    return scored.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, place int, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 128 << 20, block_bytes: int = 4 << 20, fan: int = 512) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    A's text has a space before it, as B adds one. A pair's count is the number of rows
    that hold it linked, so repeated rows count each. Texts that are null, empty or not
    restored byte by byte by both tokenizers have zeros and an empty digest; very long texts
    are taken whole; null ids stay; an empty table gives no rows; other columns are ignored.
    stripe_bytes bounds the dense matrix of a stripe. Links of `fan` blocks of a stripe go
    to one task, so hot ids are split by block; a task reads them row by row.
    """
    rows = encode_links(docs, path_a, path_b, id_col, text_col, stripe_bytes, block_bytes)
    salts = max(1, -(-rows.where("place = 0").count() // fan))
    links = rows.where("stripe >= 0").select("block", "stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "size", "codes", "holders", "places", "times")
    counts = _summed(links, ["stripe", "salt"], path_a, path_b, stripe_bytes)
    if salts > 1:
        counts = _summed(counts, ["stripe"], path_a, path_b, stripe_bytes)
    counts = materialise(counts, "counts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scores = _by_document(_scored(links, counts))
    whole = rows.where("stripe < 0").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    score = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return whole.join(scores, ["block", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *score, "groups_sha256")


def best_partners(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 128 << 20) -> DataFrame:
    """a, b, documents of every linked pair whose count is the highest of its A id (ties: all), the rows of a translation table."""
    rows = encode_links(docs, path_a, path_b, id_col, text_col, stripe_bytes)
    counts = _summed(rows.where("stripe >= 0"), ["stripe"], path_a, path_b, stripe_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        stripes = stripes_of(pair, stripe_bytes)
        for b in batches:
            for k, s in enumerate(b.column("stripe").to_pylist()):
                code, n = _codes(b, k)
                keep = unpack(b.column("best")[k].as_py(), len(code)) > 0
                code = code[keep]
                yield pa.RecordBatch.from_arrays([pa.array(code // pair.n_b * stripes + s), pa.array(code % pair.n_b), pa.array(n[keep])], names=["a", "b", "documents"])

    return counts.mapInArrow(run, "a long, b long, documents long")
