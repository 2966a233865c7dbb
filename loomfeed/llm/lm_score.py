"""Language-model scores of documents.

Each task deals its documents into blocks of bounded size and numbers the words of each. A
block sends its distinct words with their counts in training documents once, packed by the
words' hash; where equal words meet, counts are summed over the corpus and each word is
encoded once, and both go back to the blocks that hold the word, so the traffic is of
distinct words, not of tokens. Then each text is a row of subword ids and of its words'
counts. Word counts give the base score, and the model mixes them with a causal
self-attention model over subword ids, which gives the class of the next word. That model
starts from a few steps on the driver; then each task trains a copy, every weight of it, on
all windows of its training texts, and the copies are averaged. The mixture's weight is
fitted on what the copies foretold of each window before they were trained on it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import BIN, BINS, CLASSES, DIM, Attention, Pass, classes, features, frequent, table_rows, take_means, windows
from .common import discard, materialise, trim
from .wordnp import hashes

END = b" "  # no word is a space
_subwords: dict = {}
#: Spaces that words may begin or end with.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Subwords(dict):
    """word -> ids as int32 bytes, of a public rank file; the end is the id after the last one. Emptied when it holds `bound` words."""

    def __init__(self, path: str, pattern: str, bound: int = 300_000):
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1
        self.size, self.bound = self.end + 1, bound
        self.begins = np.zeros(self.size, bool)  # words are encoded with a space before them
        self.begins[[n for token, n in ranks.items() if token[:1] == b" "] + [self.end]] = True
        self.encode = tiktoken.Encoding(f"subwords-{path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tail = np.int32(self.end).tobytes()

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, one after the other, and how many each has, by one call where a space is sure to begin a word."""
        text = (b" " + b" ".join(words)).decode() if words else ""
        if words and END not in words and not _ODD.search(text):
            flat = np.array(self.encode(text), np.int32)
            starts = np.flatnonzero(self.begins[flat])
            if len(starts) == len(words):
                return flat, np.diff(np.append(starts, len(flat)))
        parts = list(map(self.__getitem__, words))
        return np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) >> 2

    def __missing__(self, word: bytes) -> bytes:
        ids = self.tail if word == END else np.array(self.encode(" " + word.decode()), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = ids
        return ids


def subwords(path: str, pattern: str) -> Subwords:
    if (path, pattern) not in _subwords:
        _subwords[path, pattern] = Subwords(path, pattern)
    return _subwords[path, pattern]


def _thin(a: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0)))).tobytes()


def _thick(b: bytes, n: int) -> np.ndarray:
    """The n numbers of _thin."""
    return np.frombuffer(b, f"u{len(b) // n}") if n else np.zeros(0, np.uint8)


def _halves(a: np.ndarray) -> bytes:
    """32-bit numbers from 0: their low 16 bits, then _thin of the high ones."""
    return a.astype(np.uint16).tobytes() + _thin(a >> 16)


def _whole(b: bytes, n: int) -> np.ndarray:
    """The n numbers of _halves."""
    return np.frombuffer(b, np.uint16, n).astype(np.int32) | _thick(b[2 * n :], n).astype(np.int32) << 16


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, one after the other, and where each begins and the last ends."""
    _, at, data = words.buffers()
    return np.frombuffer(data, np.uint8), np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1]


def _numbered(texts: pa.Array, parts: int = 1) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts and the end, by parts (their hash modulo parts); where each part begins, and the last ends; the word numbers of the texts, each with its end; how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
    code, blank = coded.indices.to_numpy(), pc.index(words, b"").as_py()  # what stands before a text's first space and after its last
    kept = np.flatnonzero(code != blank)
    sizes = np.diff(np.searchsorted(kept, lists.offsets.to_numpy())) + 1
    numbers = np.full(len(kept) + len(texts), len(words) - 1, np.int32)
    inner = np.ones(len(numbers), bool)
    inner[np.cumsum(sizes) - 1] = False
    numbers[inner] = code[kept]
    data, at = _bytes(words)
    part = (hashes(data, at[:-1], at[1:]) % np.uint64(parts)).astype(np.int64)
    if blank >= 0:
        part[blank] = parts
    order = np.argsort(part, kind="stable")
    begins = np.searchsorted(part[order], np.arange(parts + 1))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return words.take(pa.array(order[: begins[-1]])), begins, rank[numbers], sizes


def _encoded(words: list[bytes], sub: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all the words, one after the other, and how many each has."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    flat, sizes = zip(*(sub.encoded(words[i : i + 1024]) for i in range(0, len(words), 1024)))
    return np.concatenate(flat), np.concatenate(sizes)


def _spelt(numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of these numbers, and how many each has; flat, sizes: of word 0, 1, ..."""
    own = sizes[numbers].astype(np.int64)
    last = np.cumsum(own)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    return flat[np.repeat(starts[numbers] - (last - own), own) + np.arange(own.sum())], own


class Scorer:
    """(1 - u) * (weight * c / N + (1 - weight) * P(class | before) * c / C) for known words, u for the unknown word.

    c: the word's count, N: all words, C: all words of its class, which is that of its
    first subword. As in the base score, all unknown words are one event; its mass u is the
    share of words that occurred once. The probabilities of all known words and of the
    unknown one sum to 1.
    """

    def __init__(self, model: Attention, total: int, distinct: int, single: int, of_class: np.ndarray, weight: float = 0.5):
        self.model, self.total, self.distinct, self.weight = model, total, distinct, weight
        self.unknown = (single + 1) / (total + distinct + 1)
        self.log_class = np.append(np.log(np.maximum(of_class, 1)), 0.0)

    def attention_log(self, ids: list[np.ndarray], sizes: np.ndarray, end: int) -> np.ndarray:
        """Natural log of P(class | before) / C for every word and end, in order; ids: of each text, sizes: ids of each word."""
        w, real = windows(ids, end, self.model.pad)
        lp = self.model.log_p(w)[real].astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        if not len(starts):
            return np.zeros(0)
        return np.add.reduceat(lp, starts) - self.log_class[self.model.class_of[np.concatenate(ids)[starts]]]

    def mixed(self, counts: np.ndarray, attention: np.ndarray) -> np.ndarray:
        """log10 of the mixture."""
        known = counts > 0
        c = np.where(known, counts, 1)
        joint = np.log1p(-self.unknown) + np.log(c) + np.logaddexp(np.log(self.weight / max(self.total, 1)), attention + np.log1p(-self.weight)) if self.total else attention
        return np.where(known, joint, np.log(self.unknown)) / np.log(10)

    def fit_weight(self, ratios: np.ndarray, rounds: int = 20) -> None:
        """Expectation-maximisation of the weight over the ratios of Pass: of words before the model was fitted on them."""
        if not ratios.sum():
            return
        b = np.exp((np.arange(BINS) - BINS // 2 + 0.5) * BIN)
        for _ in range(rounds):
            r = self.weight / (self.weight + (1 - self.weight) * b)
            self.weight = float(np.clip((r * ratios).sum() / ratios.sum(), 0.01, 0.99))


def _runs(sizes: Iterable[int], bound: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of items whose sizes come to `bound`."""
    lo = size = end = 0
    for end, x in enumerate(sizes, 1):
        size += x
        if size >= bound:
            yield lo, end
            lo, size = end, 0
    if lo < end:
        yield lo, end


def _blocks(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.Table]:
    """All rows, in tables of some `bound` bytes of text; a longer text comes whole."""
    held, size = [], 0
    for b in batches:
        last = 0
        for i, n in enumerate(pc.binary_length(b.column("text")).to_pylist(), 1):
            size += n + 16
            if size >= bound:
                yield pa.Table.from_batches([*held, b.slice(last, i - last)])
                held, size, last = [], 0, i
        if last < len(b):
            held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, parts: int, block_bytes: int) -> DataFrame:
    """(task, doc_id, text, train) -> rows of texts and rows of words of each block.

    A text has its word numbers and how many; words come by parts, in the order of their numbers, one
    after the other with their lengths and their counts in training texts.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(_blocks(batches, block_bytes)):
            t = t.combine_chunks()
            block = t.column("task")[0].as_py() << 32 | k
            words, begins, numbers, sizes = _numbered(t.column("text").chunk(0), parts)
            ends = np.cumsum(sizes)
            train = t.column("train").to_numpy()
            c = np.bincount(numbers[np.repeat(train, sizes)], minlength=len(words))
            n, ids = len(t), t.column("doc_id").chunk(0)
            own = [_halves(numbers[e - x : e]) for e, x in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), ids, t.column("train").chunk(0), pa.array(own, pa.binary()), pa.nulls(n, pa.int32()), pa.array(sizes, pa.int32()), *[pa.nulls(n, pa.binary())] * 3], names=names)
            data, at = _bytes(words)
            lengths = np.diff(at)
            some = [(int(p), int(lo), int(hi)) for p, (lo, hi) in enumerate(zip(begins[:-1], begins[1:])) if lo < hi]
            joined = [data[at[lo] : at[hi]].tobytes() for _, lo, hi in some]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, ids.type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array([p for p, *_ in some], pa.int32()), pa.array([hi - lo for _, lo, hi in some], pa.int32()), pa.array(joined, pa.binary()), pa.array([_thin(lengths[lo:hi]) for _, lo, hi in some], pa.binary()), pa.array([_thin(c[lo:hi]) for _, lo, hi in some], pa.binary())], names=names)
        trim()

    names = ["block", "doc_id", "train", "numbers", "part", "n", "words", "lengths", "c"]
    return rows.mapInArrow(run, f"block long, doc_id {kind}, train boolean, numbers binary, part int, n int, words binary, lengths binary, c binary")


def _counted(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(block, part, n, words, lengths, c) of each block -> its words' counts in the corpus, numbers of ids, and ids.

    A part's first row also has its sum of counts, its words with a count and with a count
    of one, and how many words of training texts each subword id begins.
    """

    def run(key, t):
        sub = subwords(path, pattern)
        n = t.column("n").to_pylist()
        lengths, c = (np.concatenate([_thick(x, k) for x, k in zip(t.column(name).to_pylist(), n)]).astype(np.int64) for name in ("lengths", "c"))
        offsets = np.append(0, np.cumsum(lengths))
        coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(t.column("words").to_pylist()))]).dictionary_encode()
        code = coded.indices.to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, code, c)
        flat, sizes = _encoded(coded.dictionary.to_pylist(), sub)
        begun = np.zeros(sub.size, np.int64)
        np.add.at(begun, flat[np.cumsum(sizes) - sizes], total)
        at = np.flatnonzero(begun)
        ends, out = np.cumsum(n), []
        for k, e in zip(n, ends):
            ids, own = _spelt(code[e - k : e], flat, sizes)
            out.append((_thin(total[code[e - k : e]]), _thin(own), _thin(ids)))
        once = lambda x, kind: pa.array([x] + [None] * (len(n) - 1), kind)
        trim()
        return pa.table(
            {
                "block": t.column("block"),
                "part": t.column("part"),
                "n": t.column("n"),
                **{name: pa.array(list(x), pa.binary()) for name, x in zip(("c", "sizes", "ids"), zip(*out))},
                "total": once(int(total.sum()), pa.int64()),
                "distinct": once(int((total > 0).sum()), pa.int64()),
                "single": once(int((total == 1).sum()), pa.int64()),
                "begun": once([{"id": i, "c": x} for i, x in zip(at.tolist(), begun[at].tolist())], pa.list_(pa.struct([("id", pa.int64()), ("c", pa.int64())]))),
            }
        )

    return words.groupBy("part").applyInArrow(run, "block long, part int, n int, c binary, sizes binary, ids binary, total long, distinct long, single long, begun array<struct<id: long, c: long>>")


def _streams(texts: DataFrame, counted: DataFrame, total: int, distinct: int) -> DataFrame:
    """Texts and words of the blocks -> doc_id, train, n_tokens, n_known, base_score, and of each text the ids as int32, its words' numbers of ids and their counts."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(left, right):
        right = right.sort_by("part")
        n = right.column("n").to_pylist()
        c, sizes = ([_thick(x, k) for x, k in zip(right.column(name).to_pylist(), n)] for name in ("c", "sizes"))
        flat = np.concatenate([_thick(x, int(own.sum())) for x, own in zip(right.column("ids").to_pylist(), sizes)]).astype(np.int32)
        c, sizes = (np.concatenate(x).astype(np.int64) for x in (c, sizes))
        base = np.log10((c + 1) / (total + (distinct + 1)))
        known = (c > 0).astype(np.int64)
        out = {name: [] for name in ("n_tokens", "n_known", "base_score", "ids", "sizes", "counts")}
        texts = list(map(_whole, left.column("numbers").to_pylist(), left.column("n").to_pylist()))
        for lo, hi in _runs(map(len, texts), 40_000):
            words = np.concatenate(texts[lo:hi])
            tokens = np.array([len(x) for x in texts[lo:hi]])
            ends = np.cumsum(tokens)
            ids, own = _spelt(words, flat, sizes)
            out["n_tokens"] += tokens.tolist()
            out["n_known"] += np.add.reduceat(known[words], ends - tokens).tolist()
            out["base_score"] += np.add.reduceat(base[words], ends - tokens).tolist()
            out["ids"] += [x.tobytes() for x in np.split(ids, np.cumsum(own)[ends[:-1] - 1])]
            out["sizes"] += map(_thin, np.split(own, ends[:-1]))
            out["counts"] += map(_thin, np.split(c[words], ends[:-1]))
        kinds = pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()
        table = pa.table({"doc_id": left.column("doc_id"), "train": left.column("train"), **{name: pa.array(x, t) for (name, x), t in zip(out.items(), kinds)}})
        del texts, out
        trim()
        return table

    return texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, ids binary, sizes binary, counts binary")


def _id_streams(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(text, kept) -> (ids, kept): the subword ids of each text and its end as int32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path, pattern)
        for t in _blocks(batches, 8_000_000):
            t = t.combine_chunks()
            words, _, numbers, n = _numbered(t.column("text").chunk(0))
            ids, sizes = _spelt(numbers, *_encoded(words.to_pylist(), sub))
            ends = np.cumsum(sizes)[np.cumsum(n) - 1]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary()), t.column("kept").chunk(0)], names=["ids", "kept"])
        trim()

    return rows.mapInArrow(run, "ids binary, kept boolean")


def _arrays(batches: Iterator[pa.RecordBatch], bound: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """The ids of texts, some `bound` ids at a time; a longer text comes whole."""
    part, size = [], 0
    for b in batches:
        for x in b.column("ids").to_pylist():
            part.append(np.frombuffer(x, np.int32))
            size += len(part[-1])
            if size >= bound:
                yield part
                part, size = [], 0
    if part:
        yield part


def _row_sums(df: DataFrame, run, n: int, width: int) -> np.ndarray:
    """The sum, over the tasks of df, of the rows that run(batches) returns as (distinct row numbers, rows of float32)."""
    piece = 2048
    parts = df.mapInArrow(lambda batches: _pieces(*run(batches), piece), "piece int, at binary, rows binary")

    def add(key, t):
        out = np.zeros((piece, width))
        for at, rows in zip(t.column("at"), t.column("rows"), strict=True):
            out[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(rows.as_py(), np.float32).reshape(-1, width)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    total = np.zeros((-(-n // piece) * piece, width), np.float32)
    for r in parts.groupBy("piece").applyInArrow(add, "piece int, rows binary").collect():
        total[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(bytes(r["rows"]), np.float32).reshape(-1, width)
    return total[:n]


def _pieces(at: np.ndarray, rows: np.ndarray, piece: int) -> Iterator[pa.RecordBatch]:
    for k in np.unique(at // piece):
        own = at // piece == k
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(at[own] - k * piece).astype(np.int32).tobytes()], pa.binary()), pa.array([rows[own].astype(np.float32).tobytes()], pa.binary())], names=["piece", "at", "rows"])


def _features(streams: DataFrame, top: np.ndarray, n: int) -> np.ndarray:
    """features() of all texts."""

    def run(batches):
        out = np.zeros((n, len(top)))
        for ids in _arrays(batches):
            out += features(ids, top, n)
        at = np.flatnonzero(out.any(1))
        return at, out[at]

    return _row_sums(streams, run, n, len(top)).astype(np.float64)


def _trained(model: Attention, streams: DataFrame, start: int) -> tuple[int, np.ndarray]:
    """Train all weights on all windows, a copy for each task's texts, and average the copies; the number of windows and the ratios of Pass."""
    held = streams.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        over = Pass(held.value)
        for ids in _arrays(batches):
            over.add(windows(ids, start, over.model.pad)[0])
        over.close()
        trim()
        return over.table(held.value)

    return take_means(model, _row_sums(streams, run, table_rows(model), DIM + 1))


def train_all(model: Attention, streams: DataFrame, start: int) -> int:
    """Train all weights on all windows; the number of windows."""
    return _trained(model, streams, start)[0]


def fit(counts: np.ndarray, total: int, distinct: int, single: int, streams: DataFrame, first: list[np.ndarray], path: str, pattern: str, steps: int) -> Scorer:
    """Train the attention model and fit the weight on all streams; its weights start from some steps on the ids `first`. counts: of the words that each id begins."""
    sub = subwords(path, pattern)
    top = frequent(counts)
    top = top[counts[top] > 0] if counts.any() else np.array([sub.end])
    class_of = classes(_features(streams, top, len(counts)), top, sub.begins)
    of_class = np.bincount(np.maximum(class_of, 0), np.where(class_of >= 0, counts, 0), CLASSES)
    model = Attention(sub.size, class_of, of_class)
    w, _ = windows(first, sub.end, model.pad)
    if len(w) and steps:
        model.train(w, steps)
    _, ratios = _trained(model, streams, sub.end)
    scorer = Scorer(model, total, distinct, single, of_class)
    scorer.fit_weight(ratios)
    return scorer


def score(docs: DataFrame, path: str, pattern: str, folds: int = 7, held: int = 2, sample: int = 1500, steps: int = 400, block_bytes: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Rows whose crc32 of the id as text leaves `held` modulo `folds` are held out; word and
    subword counts and classes come from all others, and every window of all of them trains
    every weight of the attention model and counts for the mixture's weight. Training starts
    from `steps` steps on about `sample` of them. A null text is empty: its one token is the end. A null id counts as the empty
    text. Repeated rows count and are scored each; an empty table gives no rows; texts
    are scored whole, in overlapping windows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("fold", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds).withColumn("train", F.col("fold") != held)
    n_bytes, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    parts = 8 * max(1, round(np.sqrt(n_bytes / block_bytes)))
    dealt = materialise(_dealt(rows.select(F.spark_partition_id().cast("long").alias("task"), "doc_id", "text", "train"), parts, block_bytes), "words")
    counted = materialise(_counted(dealt.where("part IS NOT NULL").select("block", "part", "n", "words", "lengths", "c"), path, pattern), "word-counts")
    total, distinct, single = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "single"))).first()
    counts = np.zeros(subwords(path, pattern).size, np.int64)
    for r in counted.where("begun IS NOT NULL").select(F.explode("begun").alias("x")).groupBy("x.id").agg(F.sum("x.c").alias("c")).collect():
        counts[r["id"]] = r["c"]
    streams = materialise(_streams(dealt.where("part IS NULL").select("block", "doc_id", "train", "n", "numbers"), counted.select("block", "part", "n", "c", "sizes", "ids"), total, distinct), "ids")
    discard(dealt)
    discard(counted)
    share = min(1.0, sample / max(1, n_train))
    drawn = rows.where("train").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < share * (1 << 20)).orderBy("doc_id")
    first = [np.frombuffer(r["ids"], np.int32) for r in _id_streams(drawn.select("text", F.lit(True).alias("kept")), path, pattern).collect()]
    scorer = fit(counts, total, distinct, single, streams.where("train").select("ids"), first, path, pattern, steps)
    held_model = spark.sparkContext.broadcast(scorer)
    end = subwords(path, pattern).end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held_model.value
        for b in batches:
            tokens = b.column("n_tokens").to_numpy()
            for lo, hi in _runs(tokens.tolist(), 40_000):
                part, n = b.slice(lo, hi - lo), tokens[lo:hi].tolist()
                sizes, c = (np.concatenate([_thick(x, k) for x, k in zip(part.column(name).to_pylist(), n)]).astype(np.int64) for name in ("sizes", "counts"))
                ids = [np.frombuffer(x, np.int32) for x in part.column("ids").to_pylist()]
                full = np.add.reduceat(model.mixed(c, model.attention_log(ids, sizes, end)), np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.invert(part.column("train")), part.column("n_tokens"), part.column("n_known"), pa.array([total] * len(n), pa.int64()), part.column("base_score"), pa.array(full, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return streams.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
