"""Quality classifier: perplexity under an n-gram model of trusted text.

For each language an interpolated modified Kneser-Ney model of byte n-grams is trained on
all trusted documents, as DataFrame aggregations and joins: counts, left
extensions, discounts, context weights and, order by order, interpolated probabilities.
The model is a table cut into shards by language and the byte before the last, which all
orders of an n-gram and its contexts have in common. Documents are dealt into blocks; a
block sends its distinct n-grams once to their shards, where they are joined with the
model, and gets their log-probabilities back. Thresholds are quantiles of all trusted
documents of a language.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordnp
from .common import discard, materialise, partitions, trim

ORDER = 5
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Language of rows without one, and of the model for languages without trusted text.
ANY = ""
#: Trusted ids that are broadcast at a time; blocks whose requests meet one copy of a shard.
IDS, BLOCKS = 1_000_000, 128


def byte_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the packed n-gram that ends there (line feeds stand before each text), and its text's index."""
    n = np.diff(off)
    padded = np.full(len(data) + (ORDER - 1) * len(n), 10, np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(data)) + (ORDER - 1) * (text + 1)
    padded[at] = data
    key = np.zeros(len(padded), np.uint64)
    for k in range(ORDER):
        key[k:] |= padded[: len(padded) - k] << np.uint64(8 * k)
    return key[at], text


class Table:
    """A hash table of unsigned 64-bit keys and float32 values with vectorised look-up."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (4 * len(keys) // 3).bit_length())  # 4/3 to 8/3 slots a key
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, _FREE), np.zeros(size, np.float32)
        left = np.arange(len(keys))
        slot = wordnp.mix(keys) & self.mask
        while len(left):
            free = self.keys[slot[left]] == _FREE
            some = left[free]
            self.keys[slot[some]] = keys[some]  # of several, the last one stays
            won = self.keys[slot[some]] == keys[some]
            self.values[slot[some[won]]] = values[some[won]]
            left = np.concatenate([left[~free], some[~won]])
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """values and whether each key is there."""
        slot = wordnp.mix(keys) & self.mask
        have = self.keys[slot]
        hit = have == keys
        out = np.where(hit, self.values[slot], np.float32(0))
        left = np.flatnonzero(~hit & (have != _FREE))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            have = self.keys[slot[left]]
            same = have == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            hit[left[same]] = True
            left = left[~same & (have != _FREE)]
        return out, hit


def _mask(k: int) -> int:
    return (1 << 8 * k) - 1


def _taught(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(model, text) of all trusted rows. Their ids are broadcast IDS at a time, so that no text moves; more of them take more reads."""
    parts = max(1, -(-trusted.count() // IDS))
    part = lambda df, i: df if parts == 1 else df.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == i)
    out = [part(docs, i).join(F.broadcast(part(trusted, i)), "doc_id", "left_semi") for i in range(parts)]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0].select(F.col("lang").alias("model"), "text")


def _counts(docs: DataFrame) -> DataFrame:
    """(model, text) -> (model, gram, c), summed before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model in pc.unique(b.column(0)).to_pylist():
                for _, _, data, off in wordnp.slices(b.column(1).filter(pc.equal(b.column(0), model))):
                    keys, c = np.unique(byte_grams(data, off)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([model] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(c)], names=["model", "gram", "c"])
        trim()

    return docs.select("model", "text").mapInArrow(run, "model string, gram long, c long").groupBy("model", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(model, gram, c) -> (model, k, gram, p, weight): interpolated modified Kneser-Ney of all orders.

    p is the probability of the last of k bytes given the others; where p is null the row
    is a context of k - 1 bytes, and weight is what it leaves to the lower order.
    """
    top = materialise(counts.select("model", F.lit(ORDER).alias("k"), "gram", "c"), "counts")
    levels = [top]
    for k in range(ORDER - 1, 0, -1):  # lower orders count distinct left extensions
        levels.append(levels[-1].groupBy("model", F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).agg(F.count("*").alias("c")))
    grams = levels[0]
    for x in levels[1:]:
        grams = grams.unionByName(x)
    grams = materialise(grams, "grams")
    n = grams.groupBy("model", "k").agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    full = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = [F.when(full, F.greatest(F.least(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(i - 0.05)), F.lit(0.1))).otherwise(F.lit(plain)).alias(f"d{i}") for i, plain in ((1, 0.5), (2, 0.75), (3, 0.9))]
    cut = grams.join(n.select("model", "k", *d), ["model", "k"]).select("model", "k", "gram", "c", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"), F.shiftright("gram", 8).alias("context"))
    cut = materialise(cut, "discounted")
    contexts = materialise(cut.groupBy("model", "k", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight")), "contexts")
    lower, out = None, contexts.select("model", "k", F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "weight")
    for k in range(1, ORDER + 1):
        x = cut.where(F.col("k") == k).join(contexts.where(F.col("k") == k).drop("k"), ["model", "context"])
        if lower is None:
            x = x.withColumn("below", F.lit(1 / 256))
        else:
            x = x.withColumn("gram_", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(lower.select("model", F.col("gram").alias("gram_"), F.col("p").alias("below")), ["model", "gram_"])
        lower = materialise(x.select("model", F.lit(k).alias("k"), "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")).alias("p"), F.lit(None).cast("double").alias("weight")), "order")
        out = out.unionByName(lower)
    for x in (top, grams, cut):
        discard(x)
    return out


def _shards(model: DataFrame) -> DataFrame:
    """(model, byte, shard): the model's rows by the byte before the last, packed; unigrams are in every shard."""
    own = F.when(F.col("p").isNotNull(), F.shiftright("gram", 8)).otherwise(F.col("gram")).bitwiseAND(F.lit(255)).cast("int")
    rows = model.withColumn("byte", F.explode(F.when(F.col("k") > 1, F.array(own)).otherwise(F.sequence(F.lit(0), F.lit(255)))))

    def pack(key, t):
        k, gram = t.column("k").to_numpy(), t.column("gram").to_numpy().astype(np.uint64)
        p, w = t.column("p").to_numpy(), t.column("weight").to_numpy()
        arrays = {}
        for i in range(1, ORDER + 1):
            for name, value in (("p", p), ("w", w)):
                at = np.flatnonzero((k == i) & ~np.isnan(value))
                at = at[np.argsort(gram[at])]
                arrays[f"{name}{i}"], arrays[f"{name}{i}v"] = gram[at], np.log(value[at]).astype(np.float32)
        np.savez(held := io.BytesIO(), **arrays)
        return pa.table({"model": pa.array([key[0].as_py()], pa.string()), "byte": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([held.getvalue()], pa.binary())})

    return rows.groupBy("model", "byte").applyInArrow(pack, "model string, byte int, shard binary")


def _look_up(keys: np.ndarray, shard) -> np.ndarray:
    """Natural log of the probability of each packed n-gram's last byte; all have the shard's byte before it."""
    out, left = np.zeros(len(keys), np.float32), np.arange(len(keys))

    def get(name: str, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, value = shard[name], shard[f"{name}v"]
        if not len(have):
            return np.zeros(len(g), np.float32), np.zeros(len(g), bool)
        at = np.minimum(np.searchsorted(have, g), len(have) - 1)
        hit = have[at] == g
        return np.where(hit, value[at], np.float32(0)), hit

    for k in range(ORDER, 0, -1):
        g = keys[left] & np.uint64(_mask(k))
        value, hit = get(f"p{k}", g)
        out[left] += value
        left, g = left[~hit], g[~hit]
        out[left] += get(f"w{k}", g >> np.uint64(8))[0]
    out[left] += np.float32(np.log(1 / 256))
    return out


def _shrunk():
    """A column function: a text as its length in bytes (4 of them) and zstd."""

    def shrink(text: pa.Array) -> pa.Array:
        raw = [t.as_buffer() for t in text.cast(pa.large_binary())]
        return pa.array([len(t).to_bytes(4, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in raw], pa.binary())

    return F.arrow_udf(shrink, "binary")


def _texts(t: pa.Table) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(model, row numbers, texts) of a block, some 4 MB of texts at a time."""
    models = t.column("model").to_pylist()
    packed = t.column("packed").to_pylist()
    for model in sorted(set(models)):
        part, size = [], 0
        for i in [*(i for i, m in enumerate(models) if m == model), None]:
            if i is not None:
                part.append(i)
                size += int.from_bytes(packed[i][:4], "little")
            if part and (i is None or size >= 1 << 22):
                texts = [pa.decompress(packed[k][4:], decompressed_size=int.from_bytes(packed[k][:4], "little"), codec="zstd", asbytes=True) for k in part]
                yield model, np.array(part), pa.array(texts, pa.large_binary()).cast(pa.large_string())
                part, size = [], 0


def _distinct(t: pa.Table) -> dict[str, np.ndarray]:
    """model -> the distinct n-grams of a block, in order of the byte before the last."""
    out: dict[str, np.ndarray] = {}
    for model, _, texts in _texts(t):
        for _, _, data, off in wordnp.slices(texts):
            keys = np.unique(byte_grams(data, off)[0])
            out[model] = np.union1d(out[model], keys) if model in out else keys
    return {m: k[np.argsort((k >> np.uint64(8)) & np.uint64(255), kind="stable")] for m, k in out.items()}


def _requests(rows: DataFrame, salts: int) -> DataFrame:
    """(model, byte, salt, block, keys): the distinct n-grams of each block."""

    def run(key, t):
        out: dict[str, list] = {"model": [], "byte": [], "salt": [], "block": [], "keys": []}
        block = key[0].as_py()
        for model, keys in _distinct(t).items():
            byte = (keys >> np.uint64(8)) & np.uint64(255)
            cut = np.append(np.flatnonzero(np.append(True, byte[1:] != byte[:-1])), len(byte)) if len(byte) else [0]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                planes = np.diff(keys[x:y], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
                for name, value in zip(out, (model, int(byte[x]), block % salts, block, np.uint32(y - x).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)), strict=True):
                    out[name].append(value)
        trim()
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)})

    return rows.groupBy("block").applyInArrow(run, "model string, byte int, salt int, block int, keys binary")


def _unpacked(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed[:4], np.uint32)[0])
    raw = pa.decompress(packed[4:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _answers(requests: DataFrame, shards: DataFrame) -> DataFrame:
    """(block, model, byte, logs): the log-probability of each n-gram of a request, as float32."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            left = left.slice(0, 0)
        shard = dict(np.load(io.BytesIO(right.column("shard")[0].as_py()))) if left.num_rows else None
        logs = [_look_up(_unpacked(x), shard).tobytes() for x in left.column("keys").to_pylist()]
        return pa.table({"block": left.column("block"), "model": left.column("model"), "byte": left.column("byte"), "logs": pa.array(logs, pa.binary())})

    return requests.groupBy("model", "byte", "salt").cogroup(shards.groupBy("model", "byte", "salt")).applyInArrow(run, "block int, model string, byte int, logs binary")


def _scores(rows: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """(doc_id, lang, model, key, n, nats): bytes and summed negative log-probability of each text; without an answer nats is null."""

    def run(left, right):
        n, nats = np.zeros(left.num_rows, np.int64), np.full(left.num_rows, np.nan)
        names, bytes_, logs = (right.column(k).to_pylist() for k in ("model", "byte", "logs"))
        tables = {}
        for model, keys in _distinct(left).items():
            own = sorted((b, x) for m, b, x in zip(names, bytes_, logs, strict=True) if m == model)
            values = np.frombuffer(b"".join(x for _, x in own), np.float32)
            if len(own):
                assert len(values) == len(keys), "requests and answers of a block differ"
                tables[model] = Table(keys, values)
        for model, at, texts in _texts(left):
            for lo, hi, data, off in wordnp.slices(texts, 1 << 20):
                n[at[lo:hi]] = np.diff(off)
                if model in tables:
                    keys, text = byte_grams(data, off)
                    nats[at[lo:hi]] = -np.bincount(text, tables[model].get(keys)[0].astype(np.float64), hi - lo)
        tables.clear()
        trim()
        return pa.table({**{k: left.column(k) for k in ("doc_id", "lang", "model", "key")}, "n": pa.array(n), "nats": pa.array(nats, pa.float64(), mask=np.isnan(nats))})

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, lang string, model string, key string, n long, nats double")


def _content_key(text: str, lang: str):
    """What a decision depends on, as a digest."""
    return F.md5(F.concat(F.coalesce(F.col(lang), F.lit(ANY)), F.lit("\0"), F.coalesce(F.col(text), F.lit(""))))


def _quantile(quantile: float | dict[str, float]):
    """The quantile of x of the group's language."""
    if not isinstance(quantile, dict):
        return F.percentile_approx("x", quantile, 10000)
    names = [x for x in quantile if x != ANY]
    at = F.percentile_approx("x", [*[quantile[x] for x in names], quantile.get(ANY, 0.998)], 10000)
    which = F.array_position(F.array(*[F.lit(x) for x in names]), F.first("model")) if names else F.lit(0)
    return F.element_at(at, F.when(which > 0, which).otherwise(len(names) + 1).cast("int"))


def decisions(docs: DataFrame, labels: DataFrame, quantile: float | dict[str, float] = 0.998, prior: int = 200, block_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept, key of every row; see classify().

    Texts move once, compressed, to their block; requests and scores read the same exchange.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.coalesce("lang", F.lit(ANY)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), _content_key("text", "lang").alias("key"))
    trusted = materialise(labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct(), "trusted")
    ids = materialise(plain.select("lang", F.octet_length("text").cast("long").alias("n")), "ids")
    counts = materialise(_counts(_taught(plain.where("text <> ''"), trusted)), "counts")
    langs = materialise(counts.select(F.col("model").alias("lang"), F.lit(True).alias("taught")).distinct(), "languages")
    pooled = counts.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(ANY).alias("model"), "gram", "c")
    if not langs.where(F.col("lang") == ANY).isEmpty():
        pooled = pooled.limit(0)
    blocks = max(1, -(-(ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // block_bytes))
    salts = -(-blocks // BLOCKS)
    shards = materialise(_shards(kneser_ney(counts.unionByName(pooled))), "shards").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = plain.join(langs, "lang", "left").withColumn("model", F.when(F.col("taught"), F.col("lang")).otherwise(F.lit(ANY))).withColumn("own", F.lit(True))
    if not ids.join(langs, "lang", "left_anti").isEmpty():
        # the pooled model judges rows without a model of their language, so its threshold needs all trusted rows under it
        rows = rows.unionByName(plain.join(trusted, "doc_id", "left_semi").join(langs.where(F.col("lang") != ANY), "lang").withColumns({"model": F.lit(ANY), "own": F.lit(False)}))
    rows = rows.select("doc_id", "lang", "model", "own", "key", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("at"), "text")
    # copies of one text are told from each other by their rows, so that a large group is not one block
    rows = rows.withColumn("block", F.pmod(F.col("at") + F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    rows = rows.select("block", "doc_id", "lang", "model", F.concat(F.when(F.col("own"), F.lit("+")).otherwise(F.lit("-")), "key").alias("key"), _shrunk()("text").alias("packed")).repartition(partitions(spark), "block")
    scores = materialise(_scores(rows, _answers(_requests(rows, salts), shards), docs.schema["doc_id"].dataType.simpleString()), "scores")
    scored = scores.where("n > 0 AND nats IS NOT NULL").join(trusted, "doc_id", "left_semi")
    mean = scored.groupBy("model").agg((F.sum("nats") / F.sum("n")).alias("mean"))
    x = (F.col("nats") + prior * F.col("mean")) / (F.col("n") + prior)
    limits = materialise(scored.join(mean, "model").withColumn("x", x).groupBy("model").agg(F.first("mean").alias("mean"), _quantile(quantile).alias("limit")), "thresholds")
    kept = F.coalesce(x <= F.col("limit"), F.lit(True)) | (F.col("n") == 0)
    perplexity = F.when(F.col("n") > 0, F.exp(F.col("nats") / F.col("n")))
    out = scores.where("key LIKE '+%'").join(limits, "model", "left")
    out = out.select("doc_id", "lang", F.col("n").alias("n_bytes"), perplexity.alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"), F.expr("substring(key, 2)").alias("key"))
    for t in (ids, counts, langs):
        discard(t)
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float | dict[str, float] = 0.998, prior: int = 200, block_bytes: int = 16_000_000, out_col: str = "quality") -> DataFrame:
    """docs with a struct column out_col: n_bytes, perplexity (per byte), threshold, kept.

    docs need doc_id, text and lang; labels need doc_id, quality and toxic. Trusted are
    documents with quality 1 that are not toxic; models and thresholds come from all of
    them. A document is
    rejected if its mean negative log-probability, drawn towards its language's mean by
    `prior` bytes (so that short texts need more evidence), is over the language's
    threshold: the `quantile` of its trusted documents, one number or one by language (with
    ANY for those that are not named). Null and
    empty texts have a null perplexity and are kept; null languages and those without
    trusted text use the model of all languages and its own threshold; without any trusted
    text all is kept. A value at the threshold is kept. Repeated rows score alike; an empty
    table gives no rows. out_col must not be a column of docs; other columns stay.
    """
    made = decisions(docs, labels, quantile, prior, block_bytes)
    made = made.groupBy("key").agg(F.first(F.struct("n_bytes", "perplexity", "threshold", "kept")).alias("made"))
    rows = docs.select(F.struct("*").alias("row")).select("row", _content_key("row.text", "row.lang").alias("key"))
    return rows.join(made, "key").select("row.*", F.col("made").alias(out_col))
