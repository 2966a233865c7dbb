"""Byte-level BPE with a segment tree.

The leaves of the tree are byte positions; a leaf holds the rank of the pair that starts
there with its position, an inner node the smallest of FAN nodes below it. A merge reads
the root, then updates the leaves of the merged pair and of its live neighbours and the
nodes above them, each in logarithmic time, so a part of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .memo import Memo, Recent, Unsafe

_codecs: dict = {}
_NONE = 1 << 62
#: Nodes below one inner node.
FAN = 32


def merge_ids(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one part. Bytes that have no rank raise KeyError."""
    n = len(part)
    whole = ranks.get(part)
    if whole is not None:
        return [whole]
    if n < 2:
        return [ranks[part[i : i + 1]] for i in range(n)]
    get = ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    leaves = [_NONE if (r := get(part[i : i + 2])) is None else r << shift | i for i in range(n - 1)]
    levels = [leaves]
    while len(below := levels[-1]) > FAN:
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top = levels[-1]
    end = list(range(1, n + 1))  # end[i]: where the live symbol at i ends; the next one starts there
    prev = list(range(-1, n))  # prev[i]: start of the live symbol before i
    while (low := min(top)) != _NONE:
        i = low & mask
        j = end[i]  # the right half dies
        k = end[j]
        end[i] = k
        prev[k] = i
        if j < n - 1:
            leaves[j] = _NONE
        leaves[i] = _NONE if k == n or (r := get(part[i : end[k]])) is None else r << shift | i
        h = prev[i]
        if h >= 0:
            leaves[h] = _NONE if (r := get(part[h:k])) is None else r << shift | h
        if top is not leaves:
            changed = {x for x in (h, i, j) if 0 <= x < n - 1}
            for below, above in zip(levels, levels[1:]):
                changed = {x // FAN for x in changed}
                for x in changed:
                    above[x] = min(below[x * FAN : (x + 1) * FAN])
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with a rank file; one per worker."""

    def __init__(self, path: str, pattern: str, bound: int = 500_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.matches = Recent(self._merged, bound)
        self.parts = Memo(lambda part: self._pack(" " + part), bound)

    def _merged(self, match: str) -> bytes:
        ids = merge_ids(match.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pack(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        head, _, rest = text.partition(" ")
        if not rest or not head or head[-1].isspace():
            return self._pack(text)
        try:
            return self._pack(head) + b"".join(map(self.parts.__getitem__, rest.split(" ")))
        except Unsafe:
            return self._pack(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary, little-endian uint32), for every row. A null text is empty; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encode
        for b in batches:
            ids = [encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for every row.

    The ids are decoded again from the encoded bytes. A null text is empty: no tokens and
    the digest of nothing. Repeated rows give repeated results, an empty table none; a
    part of any length takes O(n log n). Nothing moves between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, own, back = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                own.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
