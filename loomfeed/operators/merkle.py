"""Digests of a whole publication as a tree, so that a difference is found by going down from the root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import stable_hash
from ..session import materialise

#: Hex digits of a row's digest that are added up together: 60 bits, so 2**67 rows fit a sum.
_DIGITS = 15


def _leaf(keys: list[str], leaves: int):
    """A leaf by the keys' digest, the same wherever a table came from."""
    return F.pmod(F.conv(F.substring(stable_hash(*[F.col(k) for k in keys]), 1, 8), 16, 10).cast("long"), F.lit(leaves)).cast("int")


def digest_tree(df: DataFrame, keys: list[str], fanout: int = 16, levels: int = 3, columns: list[str] | None = None) -> DataFrame:
    """level, node, n_rows, digest of a tree over the rows of df: leaves at level `levels`, the root at 0.

    A row belongs to the leaf of its keys. A leaf's digest is that of the number of its rows
    and of four sums over their digests, so it does not depend on their order and partial sums
    move instead of rows; repeated rows count each. An inner node's is that of its up to
    `fanout` children's. Columns count as text, nulls as empty; leaves without rows are
    not there, an empty table has no nodes.
    """
    row = stable_hash(*[F.col(c) for c in columns or df.columns])
    parts = [F.conv(F.substring(row, 1 + k * _DIGITS, _DIGITS), 16, 10).cast("decimal(38,0)") for k in range(4)]
    rows = df.select(_leaf(keys, fanout**levels).alias("node"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    sums = rows.groupBy("node").agg(F.count("*").alias("n_rows"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)])
    nodes = materialise(sums.select("node", "n_rows", F.sha2(F.concat_ws(":", "n_rows", *[F.col(f"p{k}").cast("string") for k in range(4)]), 256).alias("digest")), "leaves")
    out = nodes.select(F.lit(levels).alias("level"), "node", "n_rows", "digest")
    for level in range(levels - 1, -1, -1):
        under = nodes.groupBy(F.floor(F.col("node") / fanout).cast("int").alias("parent"))
        child = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["digest"]))  # fanout at most
        nodes = under.agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(child, ","), 256).alias("digest")).withColumnRenamed("parent", "node").select("node", "n_rows", "digest")
        out = out.unionByName(nodes.select(F.lit(level).alias("level"), "node", "n_rows", "digest"))
    return out


def differing_leaves(a: DataFrame, b: DataFrame, fanout: int = 16, levels: int = 3) -> DataFrame:
    """node: the leaves in which two trees differ, found level by level under the nodes that differ."""
    nodes = None
    for level in range(levels + 1):
        x, y = (t.where(F.col("level") == level).select("node", F.col("digest").alias(name)) for t, name in ((a, "_a"), (b, "_b")))
        if nodes is not None:
            under = nodes.select(F.col("node").alias("_parent"))
            x, y = (t.join(under, F.floor(F.col("node") / fanout) == F.col("_parent"), "left_semi") for t in (x, y))
        nodes = x.join(y, "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
    return nodes


def changes(a: DataFrame, b: DataFrame, keys: list[str], fanout: int = 16, levels: int = 3) -> DataFrame:
    """keys, change (added, removed, changed) of the rows in which b differs from a; rows of equal leaves are not compared.

    Keys are unique and not null in both; columns are compared by name and as text.
    """
    columns = sorted(a.columns)
    trees = [materialise(digest_tree(t, keys, fanout, levels, columns), "tree") for t in (a, b)]
    where = materialise(differing_leaves(*trees, fanout, levels), "differing")
    leaf, row = _leaf(keys, fanout**levels).alias("_leaf"), stable_hash(*[F.col(c) for c in columns])
    x, y = (t.select(*keys, row.alias(name), leaf).join(where.select(F.col("node").alias("_leaf")), "_leaf", "left_semi").drop("_leaf") for t, name in ((a, "_a"), (b, "_b")))
    j = x.join(y, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return j.select(*keys, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))
