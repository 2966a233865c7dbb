"""Which set of names a fingerprint stands for."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names at most: 1023 sets.
MOST = 10


def _sets(names: list[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets, in the order of names, small ones first."""
    if len(set(names)) < len(names) or len(names) > MOST:
        raise ValueError(f"names must differ and be {MOST} at most")
    return [c for k in range(1, len(names) + 1) for c in combinations(names, k)]


def set_fingerprint(base: Column, names: Column) -> Column:
    """sha256 of the base and the names, parted by the unit separator."""
    return F.sha2(F.concat_ws("\u001f", F.array(base.cast("string")), names), 256)


def named_set(base: Column, fingerprint: Column, names: list[str]) -> Column:
    """The set, as an array in the order of names, whose fingerprint with this base is given; null for an unknown fingerprint, a null base or a null fingerprint.

    The sets are a constant of at most 1023 entries; each row tries them in place, so
    nothing is exploded or moved.
    """
    table = F.array(*[F.array(*map(F.lit, s)) for s in _sets(names)])
    found = F.filter(table, lambda s: set_fingerprint(base, s) == fingerprint)
    return F.when(base.isNotNull(), F.get(found, F.lit(0)))


def set_table(spark, names: list[str], base: str = "") -> DataFrame:
    """fingerprint, names: the look-up table of all sets for fingerprints with one base, at most 1023 rows and so small enough to broadcast."""
    rows = [(list(s),) for s in _sets(names)]
    return spark.createDataFrame(rows, "names array<string>").select(set_fingerprint(F.lit(base), F.col("names")).alias("fingerprint"), "names")
