"""Null and missing-value rules (N1-N8) as Column helpers.

Spark's defaults differ from the source semantics in a few places; these
helpers make the intended rule explicit at the call site.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_sum(x) -> Column:
    """N1: a sum that is null as soon as one input is null (Spark skips nulls)."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def na_text(x) -> Column:
    """N2: text form that keeps missing values visible as ``NA``."""
    return F.coalesce(_c(x).cast("string"), F.lit("NA"))


def null_safe_eq(a, b) -> Column:
    """N3: equality where null matches null (join keys)."""
    return _c(a).eqNullSafe(_c(b))


def keep_unless(cond: Column, value) -> Column:
    """N4: mask ``value`` only where ``cond`` is definitely true; a null
    condition keeps the value (``case_when`` falls through on NA)."""
    return F.when(~F.coalesce(cond, F.lit(False)), _c(value))


def is_not(x, value) -> Column:
    """N5: ``x != value`` that keeps rows where ``x`` is absent."""
    return ~_c(x).eqNullSafe(F.lit(value))


def unset(x) -> Column:
    """N6: empty text counts as missing."""
    return F.nullif(_c(x), F.lit(""))


def first_set(*xs) -> Column:
    """N6: first value that is neither null nor empty text (last one taken as is)."""
    cols = [_c(x) for x in xs]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def desc_nulls_last(x) -> Column:
    """N7: descending order with missing values last (Spark's default, made explicit)."""
    return _c(x).desc_nulls_last()


def asc_nulls_last(x) -> Column:
    """N7: ascending order with missing values last."""
    return _c(x).asc_nulls_last()


def tolerant(x, to: str) -> Column:
    """N8: a failed parse becomes null instead of an error (ANSI on)."""
    return _c(x).try_cast(to)
