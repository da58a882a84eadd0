"""Filters (FLT-*). Predicates are Columns so Catalyst can push them into
the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import parse_utc_or_iso
from quillspark.functions.nulls import is_not


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def where_eq(df: DataFrame, **eq) -> DataFrame:
    """FLT-01/FLT-03: conjunctive equality (chained; Catalyst merges them)."""
    for c, v in eq.items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def not_null(df: DataFrame, col: str) -> DataFrame:
    """FLT-02."""
    return df.where(F.col(col).isNotNull())


def not_value(df: DataFrame, col: str, value) -> DataFrame:
    """FLT-04: ``!= value`` keeping rows where the field is absent."""
    return df.where(is_not(col, value))


def relative_to(df: DataFrame, date_col: str, as_of, past: bool) -> DataFrame:
    """FLT-05: rows before (``past``) or at/after ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return df.where(F.col(date_col) < now) if past else df.where(F.col(date_col) >= now)


def member_of(df: DataFrame, col: str, values: list, members: DataFrame | None = None) -> DataFrame:
    """FLT-06: membership in a list; a list held as a table is a left-semi join."""
    if members is not None:
        return df.join(members.withColumnRenamed(members.columns[0], col), on=col, how="left_semi")
    return df.where(F.col(col).isin(values))


def overlaps(arr, values: list) -> Column:
    """FLT-07: array overlaps a given set."""
    return F.arrays_overlap(_c(arr), F.array(*[F.lit(v) for v in values]))


def text_matches(text, pattern: str) -> Column:
    """FLT-08: case-insensitive regex on row text."""
    return _c(text).rlike("(?i)" + pattern)


def facets(conds: dict[str, Column | None]) -> Column:
    """FLT-09: conjunction of the set facets; ``None`` (``*``) adds nothing."""
    out = F.lit(True)
    for c in conds.values():
        if c is not None:
            out = out & c
    return out


def tag_class(arr, class_id: str) -> Column:
    """FLT-10: the row carries the tag whose class id (spaces -> ``-``) is given;
    ``*`` shows all."""
    if class_id == "*":
        return F.lit(True)
    return F.array_contains(F.transform(_c(arr), lambda t: F.replace(t, F.lit(" "), F.lit("-"))), class_id)


def visible(draft, private) -> Column:
    """FLT-11: not draft and not private (absent flags count as false)."""
    return (~_c(draft).eqNullSafe(F.lit(True))) & (~_c(private).eqNullSafe(F.lit(True)))


def time_range(ts, since: str | None, until: str | None) -> Column:
    """FLT-12: inclusive range; a missing or unparsable bound is ignored."""
    s = parse_utc_or_iso(F.lit(since)) if since is not None else F.lit(None).cast("timestamp_ntz")
    u = parse_utc_or_iso(F.lit(until)) if until is not None else F.lit(None).cast("timestamp_ntz")
    return (s.isNull() | (_c(ts) >= s)) & (u.isNull() | (_c(ts) <= u))


def presence(col, mode: str) -> Column:
    """FLT-13: ``with`` / ``without`` a field, or ``all``."""
    if mode == "with":
        return _c(col).isNotNull()
    if mode == "without":
        return _c(col).isNull()
    return F.lit(True)


def keep_elements(arr, exclude_regex: str, required: list[str]) -> Column:
    """FLT-15: drop array elements whose text matches a regex or that lack a
    required field."""
    def ok(x):
        cond = ~F.coalesce(x["text"].rlike(exclude_regex), F.lit(False))
        for r in required:
            cond = cond & x[r].isNotNull()
        return cond
    return F.filter(_c(arr), ok)


def groups_with_valid(df: DataFrame, group: str, valid: Column) -> DataFrame:
    """FLT-16: keep groups having at least one valid member: a left-semi
    join on the distinct valid group keys (partially aggregated), so a huge
    group is split by AQE's skew handling instead of filling one task."""
    from quillspark.operators.joins import join_back
    keys = df.where(F.coalesce(valid, F.lit(False))).select(group).distinct()
    return join_back(df, keys, [group], "left_semi")


def active(df: DataFrame, flag: str) -> DataFrame:
    """FLT-17: rows of a configured list whose enable flag is set."""
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


def with_default_flag(df: DataFrame, flag: str, type_col: str, defaults: DataFrame, out: str) -> DataFrame:
    """FLT-18: per-type default flag overridden per row."""
    d = defaults.withColumnRenamed(defaults.columns[0], type_col).withColumnRenamed(defaults.columns[1], "_default")
    return df.join(d, on=type_col, how="left").withColumn(out, F.coalesce(F.col(flag), F.col("_default"))).drop("_default")
