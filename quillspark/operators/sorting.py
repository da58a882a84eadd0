"""Sorts, limits and top-k (SRT-*). ``orderBy`` + ``limit`` becomes
TakeOrderedAndProject (per-task top-k, then a final merge); positions in a
total order come from ``row_number_scaled`` (no single-task window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.windows import row_number_scaled


def by_date(df: DataFrame, date_col: str, id_col: str, order: str = "desc") -> DataFrame:
    """SRT-01: sort by date with the direction as a parameter; id breaks ties."""
    if order.lower().startswith("d"):
        return df.orderBy(F.col(date_col).desc_nulls_last(), F.col(id_col).desc())
    return df.orderBy(F.col(date_col).asc_nulls_last(), F.col(id_col).asc())


def page_slice(df: DataFrame, offset: int = 0, count: int | None = None) -> DataFrame:
    """SRT-02: offset then limit; count 0 = all, unset = 5."""
    if offset:
        df = df.offset(offset)
    if count == 0:
        return df
    return df.limit(5 if count is None else count)


def first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """SRT-03."""
    return df.orderBy(*order).limit(n)


def sort_nested(arr, desc: bool = False) -> Column:
    """SRT-04: sort a nested list of structs inside each row (field order = key order)."""
    return F.sort_array(arr if isinstance(arr, Column) else F.col(arr), asc=not desc)


def top_then_alpha(counts: DataFrame, n: int, count_col: str, name_col: str) -> DataFrame:
    """SRT-05: top ``n`` by count (name breaks ties), then alphabetical."""
    top = counts.orderBy(F.col(count_col).desc(), F.col(name_col)).limit(n)
    return top.orderBy(name_col)


def ranked(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Position of every row in a total order (SRT-06, SRT-08, SRT-09)."""
    return row_number_scaled(df, order, out=out)


def by_weight_or_name(reverse_by_name: bool, weight: str, name: str) -> list[Column]:
    """SRT-06: order by weight, or by name reversed when the flag is set."""
    return [F.col(name).desc()] if reverse_by_name else [F.col(weight).asc(), F.col(name).asc()]


def within_groups(df: DataFrame, group: str, order: list[Column], out: str = "pos") -> DataFrame:
    """SRT-07: position inside groups of any size (a large group is numbered
    over many tasks); ``sortWithinPartitions`` serves writers."""
    return row_number_scaled(df, order, keys=[group], out=out)


def numeric_id_order(id_col: str) -> Column:
    """SRT-09: numeric order of 64-bit ids held as text (never via double)."""
    return F.col(id_col).try_cast("bigint").asc_nulls_last()


def locale_key(x) -> Column:
    """SRT-10: locale-aware collation of a text key."""
    return F.collate(x if isinstance(x, Column) else F.col(x), "UNICODE")
