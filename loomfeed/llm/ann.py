"""Nearest vectors by inner product with an inverted multi-index.

Each half of a vector has its own small codebook; a pair of centroids is a cell. A query
walks the cells by the sum of its two halves' distances (here the negative inner products)
with a heap until they hold a measured share of the vectors, and all entries of these cells
are reranked with the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .embedding_dedup import clean_vectors


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of the rows; fewer if there are fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None] - 2 * (x @ c.T), axis=1)


def cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    h = books[0].shape[1]
    return nearest(x[:, :h], books[0]) * len(books[1]) + nearest(x[:, h:], books[1])


def walk(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, target: float) -> list[int]:
    """Cells by summed distance, nearest first, until they hold at least `target` vectors. Empty cells are left out."""
    h, width = books[0].shape[1], len(books[1])
    a, b = -(books[0] @ q[:h]), -(books[1] @ q[h:])
    i_of, j_of = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = np.sort(a).tolist(), np.sort(b).tolist()
    size = counts.tolist() if isinstance(counts, np.ndarray) else counts
    heap, out, got = [(a[0] + b[0], 0, 0)], [], 0
    while heap and got < target:
        _, i, j = heapq.heappop(heap)
        cell = i_of[i] * width + j_of[j]
        if size[cell]:
            out.append(cell)
            got += size[cell]
        # (i, j) comes from (i, j - 1), or from (i - 1, 0) if j is 0: each pair once, in order
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def needed_share(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, seed: int, queries: int = 200) -> float:
    """The share of the vectors that queries must visit for this recall, measured on the sample."""
    rng = np.random.default_rng(seed)
    q = rng.choice(len(x), min(queries, len(x)), replace=False)
    cell = cells(x, books)
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    shares = []
    for i in q:
        s = x @ x[i]
        s[i] = -np.inf
        true = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        order = walk(x[i], books, counts, len(x))
        seen = np.zeros(len(counts))
        seen[order] = np.cumsum(counts[order])
        shares += (seen[cell[true]] / len(x)).tolist()
    return float(np.quantile(shares, recall)) if shares else 1.0


def _best(q: np.ndarray, own: np.ndarray, masks: np.ndarray, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, k: int):
    """Of one block of vectors: index of the query, id and score of each query's best k."""
    at, who, score = [], [], []
    order = np.argsort(cell, kind="stable")
    x, ids, cell = x[order], ids[order], cell[order]
    for lo in range(0, len(x), 8192):
        v, vid, c = x[lo : lo + 8192], ids[lo : lo + 8192], cell[lo : lo + 8192]
        cut = np.flatnonzero(np.append(True, c[1:] != c[:-1])).tolist()
        spans = list(zip(cut, [*cut[1:], len(c)], strict=True))
        for i in range(0, len(q), 256):
            # the entries of each cell meet the queries that visit it
            part, s = q[i : i + 256], np.full((len(q[i : i + 256]), len(v)), -np.inf)
            for a, b in spans:
                rows = np.flatnonzero(masks[i : i + 256, c[a]])
                if len(rows):
                    s[rows, a:b] = part[rows] @ v[a:b].T
            ok = np.isfinite(s) & (own[i : i + 256, None] != vid[None])
            s[~ok] = -np.inf
            top = np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0)]
            low = top - 1e-9 * (1 + np.abs(np.where(np.isfinite(top), top, 0)))
            r, j = np.nonzero(ok & (s >= low[:, None]))
            at.append(r + i)
            who.append(vid[j])
            # the same sum in the same order wherever a vector lies, so that equal vectors tie
            score.append((q[i + r] * v[j]).sum(1))
    at, who, score = np.concatenate(at), np.concatenate(who), np.concatenate(score)
    order = np.lexsort((who, -score, at))
    at, who, score = at[order], who[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], who[keep], score[keep]


def search(table: DataFrame, is_query, k: int = 20, centroids: int = 64, recall: float = 0.96, sample: int = 20_000, shards: int = 16, block: int = 50_000, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for every row that the column is_query selects, among all other rows.

    Best is the largest inner product in double precision, ties to the smaller id; each
    query gets k results, or all candidates if there are fewer. Vectors that are null,
    empty, zero or hold null or non-finite components, rows with a null id and vectors
    of another length than most take no part. The query's own id is left out, repeated
    rows of it too; repeated rows of other ids are candidates of their own. An empty
    table gives no rows; other columns are ignored. Codebooks and the visited share are
    fitted on about `sample` vectors; all vectors are indexed.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    picked = table.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("q")).where("q").select("vec_id").distinct()
    vectors = clean_vectors(table, id_col, vec_col).where("vec IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "vec")
    vectors = materialise(vectors, "vectors")
    sizes = vectors.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.length("vec") == sizes["n"])
    n = sizes["count"]
    share = min(1.0, sample / n)
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).select("vec").toPandas()["vec"] if n > 1 else vectors.select("vec").toPandas()["vec"]
    if not len(rows):
        rows = vectors.select("vec").limit(sample).toPandas()["vec"]
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    half = x.shape[1] // 2
    books = (codebook(x[:, :half], centroids, seed), codebook(x[:, half:], centroids, seed + 1))
    visit = needed_share(x, books, k, recall, seed)
    width = len(books[1])
    held = spark.sparkContext.broadcast((books, visit))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, _ = held.value
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(cells(x, books).astype(np.int32))], names=["vec_id", "vec", "cell"])

    indexed = materialise(vectors.mapInArrow(index, "vec_id long, vec binary, cell int"), "index")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        counts[r["cell"]] = r["count"]
    sized = spark.sparkContext.broadcast(counts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, visit = held.value
        counts = sized.value.tolist()
        target = max(k + 1, visit * sum(counts))
        for b in batches:
            out = {"query": [], "vec": [], "shard": [], "mask": []}
            for q, v in zip(b.column("vec_id").to_pylist(), b.column("vec").to_pylist(), strict=True):
                seen = np.zeros(len(counts), bool)
                seen[walk(np.frombuffer(v, np.float64), books, counts, target)] = True
                seen = seen.reshape(-1, width)
                for s in range(min(shards, len(seen))):
                    if (m := seen[s::shards]).any():
                        out["query"].append(q)
                        out["vec"].append(v)
                        out["shard"].append(s)
                        out["mask"].append(np.packbits(m.ravel()).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["query"], pa.int64()), pa.array(out["vec"], pa.binary()), pa.array(out["shard"], pa.int32()), pa.array(out["mask"], pa.binary())], names=list(out))

    queries = indexed.join(picked, "vec_id").groupBy("vec_id").agg(F.min("vec").alias("vec"))  # of a repeated id one vector asks
    probes = materialise(queries.mapInArrow(probe, "query long, vec binary, shard int, mask binary"), "probes")
    # a shard meets the queries that look into it in blocks of both
    entry = indexed.select("vec_id", "vec", "cell", F.pmod(F.expr(f"cell div {width}"), F.lit(shards)).cast("int").alias("shard"))
    blocks = entry.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("vb")).join(probes.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("qb")), "shard")
    blocks = F.broadcast(materialise(blocks, "blocks"))  # at most `shards` rows
    entry = entry.join(blocks, "shard").withColumns({"v": F.pmod(F.xxhash64("vec_id"), F.col("vb")).cast("int"), "u": F.explode(F.sequence(F.lit(0), F.col("qb") - 1))}).select("shard", "v", "u", "vec_id", "vec", "cell")
    probes = probes.join(blocks, "shard").withColumns({"u": F.pmod(F.xxhash64("query"), F.col("qb")).cast("int"), "v": F.explode(F.sequence(F.lit(0), F.col("vb") - 1))}).select("shard", "v", "u", "query", "vec", "mask")

    def rerank(left, right):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        x = np.frombuffer(b"".join(left.column("vec").to_pylist()), np.float64).reshape(left.num_rows, -1)
        q = np.frombuffer(b"".join(right.column("vec").to_pylist()), np.float64).reshape(right.num_rows, -1)
        cell = left.column("cell").to_numpy()
        inside = cell // width // shards * width + cell % width  # number of the cell within its shard
        masks = np.unpackbits(np.frombuffer(b"".join(right.column("mask").to_pylist()), np.uint8).reshape(right.num_rows, -1), axis=1).astype(bool)
        own = right.column("query").to_numpy()
        at, who, score = _best(q, own, masks, x, left.column("vec_id").to_numpy(), inside, k)
        return pa.table({"query_id": own[at], "vec_id": who, "score": score})

    found = entry.groupBy("shard", "v", "u").cogroup(probes.groupBy("shard", "v", "u")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
