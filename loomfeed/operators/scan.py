"""Running values along an order, whatever the size of a key: range partitions, their totals, and what is carried over.

Rows are sorted into ranges once and written with the number of their range. A running
value is a window inside one key's part of one range, plus what the key's earlier ranges
amount to: one row a key and range, so at most the number of ranges for a key, however
many rows it has. An order that ends in a unique column splits any key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_RANGE = "_range"
#: Kinds of running values: how rows, and then the amounts of ranges, are put together.
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column | None]], ranges: int | None = None, before: bool = False) -> DataFrame:
    """df with a column for each of `values`: name -> (kind, column), along the order within keys.

    Kinds: sum, max, min and count (1, 2, ...) of the rows up to and with this one, or, with
    `before`, of those before it; last: the value of the row just before. Null where there is
    none; nulls in a column are passed over, but for last. Keys may be empty. Ties in the
    order are put in any order, so it should end in a unique column.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = {name: (kind, F.lit(1) if kind == "count" else c) for name, (kind, c) in values.items()}
    wide = df.withColumns({f"_value_{name}": c for name, (_, c) in plan.items()})
    by = [*[F.col(k) for k in keys], *order]
    dealt = materialise(wide.repartitionByRange(n, *by).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    local = Window.partitionBy(*keys, _RANGE).orderBy(*order)
    rows = local.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inside, amounts = {}, []
    for name, (kind, _) in plan.items():
        v = F.col(f"_value_{name}")
        if kind == "last":
            inside[f"_inside_{name}"] = F.lag(v).over(local)
            inside[f"_first_{name}"] = F.row_number().over(local) == 1
            inside[f"_tail_{name}"] = F.last(v).over(local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            amounts.append(F.first(f"_tail_{name}").alias(f"_amount_{name}"))
        else:
            inside[f"_inside_{name}"] = _FOLD[kind](v).over(rows)
            amounts.append(_FOLD[kind](v).alias(f"_amount_{name}"))
    inner = dealt.withColumns(inside)
    totals = inner if any(kind == "last" for kind, _ in plan.values()) else dealt
    totals = totals.groupBy(*keys, _RANGE).agg(*amounts)
    over = Window.partitionBy(*keys).orderBy(_RANGE)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_carried_{name}": F.lag(f"_amount_{name}").over(over) if kind == "last" else _FOLD[kind](f"_amount_{name}").over(earlier) for name, (kind, _) in plan.items()}
    totals = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(_RANGE).alias("_of"), *[c.alias(name) for name, c in carried.items()])
    cond = F.col(_RANGE) == F.col("_of")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = inner.join(totals, cond, "left")

    def put(name: str, kind: str) -> Column:
        a, b = F.col(f"_inside_{name}"), F.col(f"_carried_{name}")
        if kind == "last":
            return F.when(F.col(f"_first_{name}"), b).otherwise(a)
        if kind == "max":
            return F.greatest(a, b)
        if kind == "min":
            return F.least(a, b)
        return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

    return out.select(*[F.col(c) for c in df.columns], *[put(name, kind).alias(name) for name, (kind, _) in plan.items()])

