"""Token counts with a digest cache.

The count of a text depends on its content and the tokenizer only, so counts are kept in
a table keyed by (content digest, tokenizer digest). A run joins its texts to that table,
encodes one representative of each missing content, appends the new counts and reads all
counts from the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .memo import Memo, Unsafe

_counters: dict = {}


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and of the library that runs it."""
    library = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\0{library.__name__} {library.__version__}".encode()).hexdigest()


def _counter(path: str):
    """list of texts -> list of counts, kept per worker."""
    if path in _counters:
        return _counters[path]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        bar = "▁"
        # parts are independent if no piece goes on after a word start and the model leaves texts as they are
        split = not any(bar in sp.id_to_piece(i).lstrip(bar) for i in range(sp.vocab_size()))
        sample = "a ﬁ①Å b\tc\nd"
        split = split and sp.normalize(sample) == bar + sample.replace(" ", bar)
        memo = Memo(lambda part: len(sp.encode(part)))

        def count(texts: list[str]) -> list[int]:
            out = []
            for t in texts:
                try:
                    if not split or not t or bar in t:
                        raise Unsafe
                    out.append(sum(map(memo.__getitem__, t.split(" "))))
                except Unsafe:
                    out += whole([t])
            return out

    else:
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)

        def count(texts: list[str]) -> list[int]:
            return [len(x.ids) for x in tk.encode_batch(texts, add_special_tokens=False)]

    _counters[path] = count
    return count


def encode_counts(missing: DataFrame, path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens), a bounded batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            n = count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return missing.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def _cached(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, model_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row.

    A null text counts as an empty one (0 bytes, 0 tokens); repeated rows and equal texts
    each get a row but are encoded once; very long texts are encoded whole; an empty
    table gives no rows; other columns are ignored. Null ids stay null.
    cache_path: the table of counts; without it, a new one in the shared folder.
    """
    spark = docs.sparkSession
    cache_path = cache_path or fresh_path(spark, "token-cache")
    version = tokenizer_digest(model_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = _cached(spark, cache_path, version)
    # partial aggregation leaves one row of a content per task before anything moves
    missing = rows.groupBy("digest").agg(F.first("text").alias("text"))
    if known is not None:
        missing = missing.join(known, "digest", "left_anti")
    encode_counts(missing, model_path).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    known = _cached(spark, cache_path, version)
    counts = known if known is not None else spark.createDataFrame([], "digest binary, n_tokens long")
    # a retried append may repeat a content; one row each, written so that a skewed join can split the hot contents
    counts = materialise(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    keyed = rows.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return keyed.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
