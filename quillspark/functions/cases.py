"""Case logic, lookups and tolerant casts (FN-C*, FN-M*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_match(branches: list[tuple[Column, object]], default=None) -> Column:
    """FN-C1: multi-branch case in the given order; first match wins."""
    out = None
    for cond, val in branches:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def code_label(x, labels: dict) -> Column:
    """FN-C2: code -> label, unknown code -> null."""
    m = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return F.try_element_at(m, _c(x))


def one_hot(x, codes: list[str], prefix: str) -> dict:
    """FN-C4: one flag column per code of a packed code list."""
    return {f"{prefix}{c}": F.coalesce(_c(x).rlike(f"[{c}]"), F.lit(False)).cast("int") for c in codes}


def latest_of(*kinds) -> Column:
    """FN-C5: time of a message over several event kinds; later kinds in
    source order override earlier ones, no time at all gives 0."""
    return F.coalesce(*[_c(k) for k in reversed(kinds)], F.lit(0))


def log_weight(n, lo, hi) -> Column:
    """FN-M1: ``(ln n - ln lo) / (ln hi - ln lo)`` where ``hi`` is the
    maximum plus one, which keeps the denominator above zero."""
    return (F.ln(_c(n)) - F.ln(_c(lo))) / (F.ln(_c(hi)) - F.ln(_c(lo)))


def font_size(weight, small: float = 0.8, big: float = 2.5) -> Column:
    """FN-M1: weight mapped onto the font size range (rem)."""
    return F.lit(small) + F.lit(big - small) * _c(weight)


BONUS_RATE = 0.0032  # fixed value: payoff share paid for decision tasks


def bonus(task, given, payoff1, payoff2) -> Column:
    """FN-M2: task > 2 keeps the given bonus, 1 and 2 pay a share of payoff 1 or 2."""
    t = _c(task)
    return (F.when(t > 2, _c(given)).when(t == 1, F.lit(BONUS_RATE) * _c(payoff1))
            .when(t == 2, F.lit(BONUS_RATE) * _c(payoff2)))
