"""Set operations (SET-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """SET-01: union all, columns matched by name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def union_distinct(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """SET-02: union of row sets, one row per key."""
    return a.unionByName(b).dropDuplicates(key)


def intersect_on(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """SET-03: rows of ``a`` whose key is in ``b`` (left-semi keeps a's rows)."""
    return a.join(b.select(*key).distinct(), on=key, how="left_semi")


def columns_except(df: DataFrame, drop: list[str]) -> list[str]:
    """SET-04: column-name difference, order kept."""
    return [c for c in df.columns if c not in set(drop)]


def tagged_union(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """SET-05: concatenate sources, each tagged with its name."""
    return union_by_name(*[d.withColumn(tag, F.lit(name)) for name, d in parts.items()])


def fallback(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-06: ``a``, or ``b`` when ``a`` is empty -- decided inside the plan
    by a scalar subquery, with no driver-side emptiness test."""
    any_a = a.limit(1).select(F.count(F.lit(1))).scalar()   # stops at the first row found
    return a.unionByName(b.where(any_a == 0))
