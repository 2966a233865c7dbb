"""What several operators share: tables, the shared folder, text splitting, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these six.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path
    global _own
    _own = _own or tempfile.mkdtemp(prefix="loomfeed-")
    return _own


_own: str | None = None


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it again: short lineage, and any executor can read the copy."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomfeed_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote; df must not be read afterwards."""
    if path := getattr(df, "_loomfeed_path", None):
        spark = df.sparkSession
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def trim() -> None:
    """Give memory that a task has freed back to the system: workers live on, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for the nodes of edges (u, v); component is the smallest node that links reach.

    Alternating large-star and small-star rounds, each a partially aggregated minimum
    and a join; between rounds the edges are a table in the shared folder. Nulls and
    self-loops are ignored; an empty input gives an empty result. Ends when the edges are
    stars, and raises where `rounds` do not get there.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        # done when every node but the smallest ones has one link, and to a smallest one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 OR up = 1 AND low = 1").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = small.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        new = materialise(small, "small")
        discard(e)
        discard(large)
        e = new
    else:
        raise RuntimeError(f"links are not reduced to stars after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
