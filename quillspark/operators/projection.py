"""Projections, selectors, renames, derived columns and masking (PRJ-*)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.nulls import first_set, keep_unless


def first_then_sorted(df: DataFrame, first: list[str]) -> DataFrame:
    """PRJ-01: named columns first, the rest in sorted order."""
    rest = sorted(set(df.columns) - set(first))     # SET-04: column-name difference
    return df.select(*first, *rest)


def select_like(df: DataFrame, starts: tuple = (), ends: tuple = (), exclude: bool = False) -> DataFrame:
    """PRJ-02: select (or drop, with ``exclude``) by name prefix / suffix."""
    def hit(c):
        return any(c.startswith(s) for s in starts) or any(c.endswith(e) for e in ends)
    cols = [c for c in df.columns if hit(c) != exclude]
    return df.select(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ-03: static rename map (unknown names are ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def clean_wide_name(name: str) -> str:
    """PRJ-04: the effective rule of the source: names containing ``player``
    lose the first ``matching.`` and the first ``.player`` (dot = any char),
    then the two leading dot parts are swapped and joined by ``_``."""
    if "player" not in name:
        return name
    if "matching" in name:
        name = re.sub("matching.", "", name, count=1)
    if re.search(".player", name):
        name = re.sub(".player", "", name, count=1)
    parts = name.split(".")
    second = parts[1] if len(parts) > 1 else "NA"
    return f"{second}_{parts[0]}"


def rename_by_rule(df: DataFrame, rule=clean_wide_name) -> DataFrame:
    """PRJ-04: apply a name rule to every column."""
    return df.toDF(*[rule(c) for c in df.columns])


def derive(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """PRJ-05: derived columns in one projection."""
    return df.withColumns(exprs)


def mask_where(df: DataFrame, cond: Column, cols: list[str]) -> DataFrame:
    """PRJ-06: set ``cols`` to null where ``cond`` is true; a null condition keeps values."""
    return df.withColumns({c: keep_unless(cond, F.col(c)) for c in cols})


def publishable(df: DataFrame, private: list[str]) -> DataFrame:
    """PRJ-07: drop private columns."""
    return df.drop(*private)


def description(summary, abstract, fallback) -> Column:
    """PRJ-08: first non-empty of summary, abstract, fallback."""
    return first_set(summary, abstract, fallback)


def effective_link(external, own) -> Column:
    """PRJ-09: an external link replaces the item's own link."""
    return first_set(external, own)
