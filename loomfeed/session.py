"""Session helpers shared by tests, the benchmark and the entry point."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "loomfeed", cpus: int | None = None) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scopes: list[str] = []


def _base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one temporary folder only where it is unset."""
    global _own
    if path := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    _own = _own or tempfile.mkdtemp(prefix="loomfeed-")
    return _own


_own: str | None = None


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in the innermost intermediates() if there is one."""
    return f"{_scopes[-1] if _scopes else _base(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of what runs inside, deleted at the end; results must have been read or written by then."""
    _scopes.append(fresh_path(spark, "run"))
    try:
        yield _scopes[-1]
    finally:
        fs, p = hadoop_path(spark, _scopes.pop())
        fs.delete(p, True)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it again: short lineage, and any executor can read the copy."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomfeed_path = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path that any of Spark's file systems may hold."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote; df must not be read afterwards."""
    if path := getattr(df, "_loomfeed_path", None):
        fs, p = hadoop_path(df.sparkSession, path)
        fs.delete(p, True)
