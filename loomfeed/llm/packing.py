"""Packing of tokenised documents into sequences of fixed length.

Documents become pieces of at most `size` tokens. The plan is best-fit decreasing over
the histogram of piece lengths, at most `size` numbers whatever the corpus: items of one
length fill the open sequences with the least sufficient room, a run of sequences at a
time. A piece takes the planned slot of its rank within its length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, trim
from .memo import Memo, Unsafe

_encoders: dict = {}


def _rank_encoder(tk):
    """text -> packed ids by ranks, several times faster than the library on short parts; None unless ids follow the merges' order."""
    import json

    import public_tokenizers
    import tiktoken

    model = json.loads(tk.to_str())["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if model.get("ignore_merges") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    made = [vocab.get(a + b) for a, b in merges]
    if None in made or made != sorted(made):
        return None
    # byte-level vocabularies write a byte as a printable character: itself, or the next free one from 256
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    singles = {c: vocab[c] for c in char if c in vocab}
    if len(singles) < 256:
        return None
    ranks = {bytes([char[c]]): i for c, i in singles.items()} | {bytes(map(char.__getitem__, a + b)): i for (a, b), i in zip(merges, made, strict=True)}
    encode = tiktoken.Encoding(f"ranks-{id(tk)}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def pack(text: str) -> bytes:
        ids = encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    return pack


def _encoder(path: str):
    """text -> ids as little-endian uint32 bytes, as the tokenizers library gives them; one per worker. encode.parts is what it remembers."""
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    special = [t.content for t in tk.get_added_tokens_decoder().values()]
    plain = '"ByteLevel"' in tk.to_str() and tk.normalizer is None and "add_prefix_space=False" in repr(tk.pre_tokenizer)

    def whole(text: str) -> bytes:
        ids = tk.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    fast = _rank_encoder(tk) if plain else None
    parts = Memo((lambda part: fast(" " + part)) if fast else (lambda part: whole(" " + part)))

    def encode(text: str) -> bytes:
        head, _, rest = text.partition(" ")
        if not plain or not rest or not head or head[-1].isspace() or any(s in text for s in special):
            return whole(text)
        try:
            return whole(head) + b"".join(map(parts.__getitem__, rest.split(" ")))
        except Unsafe:
            return whole(text)

    encode.parts = parts
    _encoders[path] = encode
    return encode


def pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; the first piece of a cut document may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), struct.pack("<I", end_id)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = memoryview(encode(t.as_py() or "") + end)
                n = len(ids) // 4
                lo, k = 0, 0
                while lo < n:
                    hi = min(n, lo + size) if lo else (n - 1) % size + 1
                    row.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                    lo, k = hi, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.parts.clear()
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): ranks first..first+count-1 of that length go to consecutive sequences.

    Best-fit decreasing. Sequences with equal content are runs of consecutive numbers, so
    the work depends on `size` only.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, number)
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = [r for r in room if r >= length]
            if not fits:
                break
            r = min(fits)
            first, n = room[r].pop()
            if not room[r]:
                del room[r]
            k = min(n, left)
            plan.append((length, rank, k, first, size - r))
            if k < n:
                room.setdefault(r, []).append((first + k, n - k))
            if r > length:
                room.setdefault(r - length, []).append((first, k))
            rank, left = rank + k, left - k
        each = size // length
        for per, n in ((each, left // each), (left % each, 1)):
            if per and n:
                for p in range(per):
                    plan.append((length, rank, n, sequences, p * length))
                    rank += n
                if size > per * length:
                    room.setdefault(size - per * length, []).append((sequences, n))
                sequences += n
    return plan


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", per_group: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    A null text is empty and becomes the end id alone; repeated rows are packed once
    each; an empty table gives no rows; null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    p = materialise(pieces(docs, path, size, end_id, id_col, text_col), "pieces")
    sizes = {r[0]: r[1] for r in p.groupBy("length").count().collect()}  # at most `size` rows
    plan = best_fit_plan(sizes, size)
    groups = max(1, -(-sum(sizes.values()) // per_group))
    # ranks within a length: groups of rows, their sizes summed up in order, row numbers inside
    dealt = p.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    before = dealt.groupBy("length", "g").agg(F.count("*").alias("c"))
    before = before.select("length", "g", (F.sum("c").over(Window.partitionBy("length").orderBy("g")) - F.col("c")).alias("before"))
    before = materialise(before, "ranks")
    ranked = dealt.join(before, ["length", "g"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    slots = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "slot_length long, lo long, k long, first long, offset long")
    out = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("k")))
    out = out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
    return out
