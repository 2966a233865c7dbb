"""Tables with versions: a manifest for each version, writers that compare and set, batches that count once.

A table is a folder with data folders, each written once, and a manifest for each version:
the data folders that make it up and the last batch of each writer. A commit writes its
data first and then creates the manifest of the next number, which only one writer can: the
file system gives a name only if it is free (HDFS and local folders; object stores need a connector
that has this). Readers take the newest manifest, so they see a commit
whole or not at all, and data of a lost race is never referred to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import hadoop_path


class Conflict(Exception):
    """Another writer has committed since the version that this one saw."""


class Refused(Exception):
    """A check of the new content failed; nothing was committed."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    facts: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.fs, _ = hadoop_path(spark, self.path)

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_versions/{number:020d}.json"

    def _read(self, path: str) -> str | None:
        _, p = hadoop_path(self.spark, path)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest; number 0 is the empty table."""
        if number is None:
            _, folder = hadoop_path(self.spark, f"{self.path}/_versions")
            names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
            number = max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)
        if number == 0:
            return Version(0)
        text = self._read(self._manifest(number))
        if text is None:
            raise KeyError(f"no version {number}")
        m = json.loads(text)
        return Version(number, tuple(m["folders"]), m["batches"], m["facts"])

    def read(self, at: Version | int | None = None) -> DataFrame:
        v = at if isinstance(at, Version) else self.version(at)
        if not v.folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in v.folders])

    def commit(self, rows: DataFrame, seen: Version, append: bool = False, batch: tuple[str, int] | None = None, facts: dict[str, str] | None = None) -> Version:
        """The version after `seen` with rows in place of, or besides, its content.

        Conflict if there is a version after `seen` already. batch: a writer's name and a
        rising number; a number that the writer has committed before changes nothing and
        returns the newest version, so a repeated batch counts once.
        """
        newest = self.version()
        if batch and newest.batches.get(batch[0], -1) >= batch[1]:
            return newest
        if newest.number != seen.number:
            raise Conflict(f"version {newest.number}, not {seen.number}")
        folder = f"data-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.parquet(f"{self.path}/{folder}")
        new = Version(seen.number + 1, (*seen.folders, folder) if append else (folder,), seen.batches | ({batch[0]: batch[1]} if batch else {}), seen.facts | (facts or {}))
        if not self._create(self._manifest(new.number), json.dumps({"folders": new.folders, "batches": new.batches, "facts": new.facts}, sort_keys=True)):
            fs, p = hadoop_path(self.spark, f"{self.path}/{folder}")
            fs.delete(p, True)
            raise Conflict(f"version {new.number} was committed first")
        return new

    def _create(self, path: str, text: str) -> bool:
        """Whether this call made the file. The text is written aside and then given its name, which fails where the name is taken, so no reader sees a part of it and only one writer has it."""
        aside = f"{self.path}/_versions/_{uuid.uuid4().hex}"
        (_, source), (_, target) = hadoop_path(self.spark, aside), hadoop_path(self.spark, path)
        out = self.fs.create(source, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() != "file":
                return not self.fs.exists(target) and bool(self.fs.rename(source, target))
            # a local rename replaces files; a second name for the file is refused where there is one
            file = self.spark.sparkContext._jvm.java.io.File
            try:
                self.spark.sparkContext._jvm.java.nio.file.Files.createLink(file(target.toUri().getPath()).toPath(), file(source.toUri().getPath()).toPath())
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                return False
            return True
        finally:
            if self.fs.exists(source):
                self.fs.delete(source, False)

    def change(self, make: Callable[[DataFrame], DataFrame], checks: Callable[[DataFrame], str | None] | None = None, batch: tuple[str, int] | None = None, tries: int = 10) -> Version:
        """Commit make(content), anew from the newest content after each conflict; checks name what is wrong with it, and then it is refused."""
        for _ in range(tries):
            seen = self.version()
            if batch and seen.batches.get(batch[0], -1) >= batch[1]:
                return seen
            rows = make(self.read(seen))
            if checks and (wrong := checks(rows)):
                raise Refused(wrong)
            try:
                return self.commit(rows, seen, batch=batch)
            except Conflict:
                continue
        raise Conflict(f"given up after {tries} tries")


def fenced_update(table: VersionedTable, requests: DataFrame, key: str, revision: str, changes: dict, fence: int | None = None, batch: tuple[str, int] | None = None) -> tuple[Version, int]:
    """(version, number of rows changed): rows that still have the revision a request (key, revision) saw get `changes` and new revisions.

    All requests hold or none is done: Refused if a row is gone or has another revision, or
    if the table's highest revision is not `fence`, the one that the caller's decision was
    made at. New revisions follow the highest, by key, so they never repeat. Conflict if
    another writer commits in between; a repeated batch changes nothing.
    """
    from ..operators.scan import running

    seen = table.version()
    if batch and seen.batches.get(batch[0], -1) >= batch[1]:
        return seen, 0
    state = table.read(seen)
    top = state.agg(F.coalesce(F.max(revision), F.lit(0)).alias("t")).first()["t"]
    if fence is not None and fence != top:
        raise Refused(f"revision {top}, not {fence}")
    asked = requests.select(key, F.col(revision).alias("_saw"), F.lit(True).alias("_asked"))
    j = state.join(asked, key, "full_outer")
    wrong = j.where(F.col("_asked") & ~F.col("_saw").eqNullSafe(F.col(revision)))
    if not wrong.isEmpty():
        raise Refused("a row has changed or is gone")
    hit = F.coalesce(F.col("_asked"), F.lit(False))
    numbered = running(j, [], [F.col(key)], {"_n": ("sum", hit.cast("long"))})
    new = {c: F.when(hit, changes[c]).otherwise(F.col(c)) for c in changes} | {revision: F.when(hit, F.lit(top) + F.col("_n")).otherwise(F.col(revision))}
    out = numbered.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])
    return table.commit(out, seen, batch=batch), requests.count()


def committed_stream(changes: DataFrame, table: VersionedTable, writer: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Merge what a stream holds into a table, a version for each batch: a batch that runs again after a failure changes nothing."""

    def put(rows: DataFrame, i: int) -> None:
        rows = rows.persist()
        table.change(lambda content: merge(content, rows), batch=(writer, i))
        rows.unpersist()

    changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
