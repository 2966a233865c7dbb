"""Exchange of generated outputs between stores, and the slices of articles that are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import latest_by
from .transitions import resolve_identities


def export_cache(artifacts: DataFrame, identity: list[str], stamp: list[str]) -> DataFrame:
    """The newest artifact of each binding (identity, task, language) in canonical order."""
    binding = [*identity, "task", "language"]
    return latest_by(artifacts, binding, *stamp).orderBy(*binding)


def export_counts(artifacts: DataFrame, exported: DataFrame, holds: DataFrame) -> DataFrame:
    """One row: artifacts exported, duplicates left out, holds by class."""
    n = artifacts.agg(F.count("*").alias("_all"))
    e = exported.agg(F.count("*").alias("artifacts"))
    kinds = ("ambiguous", "paid_failure", "fallback_pending")
    h = holds.agg(F.count("*").alias("holds"), *[F.count_if(F.col("hold_class") == k).alias(k) for k in kinds])
    return n.join(F.broadcast(e)).join(F.broadcast(h)).select("artifacts", (F.col("_all") - F.col("artifacts")).alias("skipped_duplicates"), "holds", *kinds)  # one row each


def import_cache(stored: DataFrame, given: DataFrame, articles: DataFrame, identity: list[str], key: str, immutable: list[str], untranslated: Column, id_col: str = "article_id") -> DataFrame:
    """given with the local article and an outcome.

    unresolved: not exactly one article agrees in all of identity; untranslated: dropped, by
    the condition over given's columns and the article's; repeated: the key comes twice;
    collision: stored under this key with other immutable columns; present; insert. The import
    is to be refused as a whole if there is an unresolved, repeated or colliding row.
    """
    here = resolve_identities(given, articles, identity, id_col)
    more = [c for c in articles.columns if c not in (*identity, id_col)]
    here = here.join(articles.select(id_col, *more).dropDuplicates([id_col]), id_col, "left") if more else here
    twice = given.groupBy(key).agg(F.count("*").alias("_times"))
    had = stored.select(key, *[F.col(c).alias(f"_{c}") for c in immutable], F.lit(True).alias("_had")).dropDuplicates([key])
    same = F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in immutable]), lambda x: x)
    outcome = (
        F.when(F.col(id_col).isNull(), "unresolved")
        .when(F.coalesce(untranslated, F.lit(False)), "untranslated")
        .when(F.col("_times") > 1, "repeated")
        .when(F.col("_had") & ~same, "collision")
        .when(F.col("_had"), "present")
        .otherwise("insert")
    )
    return here.join(twice, key, "left").join(had, key, "left").select(*given.columns, id_col, outcome.alias("outcome"))


def contract_matches(rows: DataFrame, current: DataFrame, keys: list[str], contract: list[str]) -> DataFrame:
    """rows that were made under the current contract of their keys; provider and model do not count."""
    c = current.select(*keys, *[F.col(x).alias(f"_{x}") for x in contract])
    out = rows.join(c, keys)
    for x in contract:
        out = out.where(F.col(x).eqNullSafe(F.col(f"_{x}")))
    return out.select(*rows.columns)


def outlets(articles: DataFrame, order: list[Column], unread: Column, limits: dict[str, int], digest: int) -> DataFrame:
    """(outlet, position, article): the newest articles are read once and sliced for each outlet; digest: the newest unread ones."""
    most = max(limits.values())
    w = Window.orderBy(*order)  # over at most `most` rows
    top = articles.orderBy(*order).limit(most).withColumn("position", F.row_number().over(w).cast("long"))
    of = F.filter(F.array(*[F.when(F.col("position") <= n, F.lit(name)) for name, n in limits.items()]), lambda x: x.isNotNull())
    sliced = top.select(F.explode(of).alias("outlet"), "position", *articles.columns)
    new = articles.where(unread).orderBy(*order).limit(digest).withColumn("position", F.row_number().over(w).cast("long")).select(F.lit("digest").alias("outlet"), "position", *articles.columns)
    return sliced.unionByName(new)


def page_counts(published: DataFrame, total: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per outlet: returned_count, limit, omitted_count, truncated; total: one row (total)."""
    n = published.groupBy("outlet").agg(F.count("*").alias("returned_count"))
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    omitted = F.greatest(F.col("total") - F.col("returned_count"), F.lit(0).cast("long"))
    return n.join(F.broadcast(total)).select("outlet", "returned_count", limit[F.col("outlet")].alias("limit"), omitted.alias("omitted_count"), (omitted > 0).alias("truncated"))


def described(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, position, column, type, nullable) of each table, from schemas alone."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for name, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return next(iter(frames.values())).sparkSession.createDataFrame(rows, "name string, position int, column string, type string, nullable boolean")


def profiled(frames: dict[str, DataFrame]) -> DataFrame:
    """described() with n_rows and n_nulls of each column, counted in one pass over each table."""
    counted = None
    for name, df in frames.items():
        columns = [f.name for f in df.schema.fields]
        one = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
        one = one.select(F.lit(name).alias("name"), F.col("n").alias("n_rows"), F.posexplode(F.array(*[F.col("n") - F.col(f"c{i}") for i in range(len(columns))])).alias("position", "n_nulls"))
        counted = one if counted is None else counted.unionByName(one)
    return described(frames).join(counted, ["name", "position"])


def next_revision(holds: DataFrame, sequence: DataFrame) -> DataFrame:
    """One row: the revision after the largest that was stored or handed out."""
    return holds.agg(F.max("revision").alias("a")).join(F.broadcast(sequence.agg(F.max("revision").alias("b")))).select((F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))) + 1).cast("long").alias("revision"))


def file_hashes(spark, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def append_run(runs: DataFrame, path: str) -> None:
    """Add runs to the log at path; part files are only ever added."""
    runs.write.mode("append").parquet(path)


def status_json(rows: DataFrame, order: list[str]) -> DataFrame:
    """One JSON object a row, in order; nulls are written."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.orderBy(*order).select(line.alias("json"))
