"""Experiment-data preparation (E2) as composable DataFrame -> DataFrame
steps. Each step is one of the library operators; ``prepare`` chains them
with ``.transform`` into one lazy plan.

Inputs are a page-time log (participant, page, timestamp) and participant
rows; exclusion lists and manual fixes are input tables, not literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.cases import first_match
from quillspark.functions.dates import seconds_between
from quillspark.functions.nulls import strict_sum
from quillspark.operators.aggregates import pivot_first, status_label, top_n_sum
from quillspark.operators.filters import groups_with_valid
from quillspark.operators.joins import join_back
from quillspark.operators.projection import mask_where
from quillspark.operators.windows import attempts
from quillspark.session import materialize

DAY_LIMIT_S = 23 * 60 * 60     # a stage longer than this was auto-advanced
MIN_TOTAL_S = 30               # sessions shorter than this are masked
SHOW_UP = 300                  # constant added per member in the group maximum


@dataclass
class Milestones:
    """Pages in study order and the stages measured between them."""
    pages: list[str]
    stages: dict = field(default_factory=dict)   # name -> (from_page, to_page)


def page_times(log: DataFrame, pid: str, page: str, ts: str, m: Milestones) -> DataFrame:
    """Wide page times (earliest per page) and stage durations in seconds."""
    wide = pivot_first(log, pid, page, m.pages, ts, "page_")
    durs = {name: seconds_between(f"page_{a}", f"page_{b}") for name, (a, b) in m.stages.items()}
    return wide.withColumns(durs)


def add_group_payoffs(df: DataFrame, group: str, payoffs: list[str]) -> DataFrame:
    """Group sums written back to each row (null if any member is null)
    and the group status label."""
    sums = df.groupBy(group).agg(*[strict_sum(p).alias(f"group_{p}") for p in payoffs])
    out = join_back(df, sums, [group])
    return out.withColumn("group_completed", status_label(F.col(f"group_{payoffs[0]}")))


def add_group_maximum(df: DataFrame, group: str, value: str, tie: str, out: str) -> DataFrame:
    """Theoretical group maximum: two best values plus the show-up constant."""
    mx = top_n_sum(df, [group], value, tie, n=2, plus=2.0 * SHOW_UP, out=out)
    return join_back(df, mx, [group], "left")


def classify_validity(df: DataFrame, id_col: str, stage_cols: list[str], exclusions: DataFrame | None = None,
                      listed_col: str | None = None) -> DataFrame:
    """``invalid``: duplicate (later attempt or listed), auto_advanced (no
    id, or a stage over a day), else empty; ``valid`` = yes when empty.
    ``exclusions`` lists values of ``listed_col`` (``id_col`` if not given)."""
    x = df
    listed = F.lit(False)
    if exclusions is not None:
        ex = exclusions.select(F.col(exclusions.columns[0]).alias("_ex")).distinct().withColumn("_listed", F.lit(True))
        x = x.join(ex, x[listed_col or id_col].eqNullSafe(ex["_ex"]), "left").drop("_ex")
        listed = F.coalesce(F.col("_listed"), F.lit(False))
    branches = [(listed | (F.col("attempt") > 1), "duplicate"), (F.col(id_col) == "", "auto_advanced")]
    branches += [(F.col(s) > DAY_LIMIT_S, "auto_advanced") for s in stage_cols]
    x = x.withColumn("invalid", first_match(branches, ""))
    if exclusions is not None:
        x = x.drop("_listed")
    return x.withColumn("valid", F.when(F.col("invalid") == "", "yes").otherwise(""))


def prepare(participants: DataFrame, log: DataFrame, *, pid: str, page: str, ts: str, id_col: str,
            group: str, m: Milestones, payoffs: list[str], human: list[str], private: list[str],
            exclusions: DataFrame | None = None) -> DataFrame:
    """The whole flow: page times -> join -> group payoffs and maxima ->
    attempts -> validity -> groups with a valid member -> masking -> public
    projection."""
    times = page_times(log, pid, page, ts, m)
    stage_cols = [s for s in m.stages if s != "time_total"]
    # one row per participant, used by several branches below: written once
    df = materialize(join_back(participants, times, [pid], "left"), "prep-participants")
    df = df.withColumn("date", F.col(f"page_{m.pages[0]}"))
    df = df.transform(add_group_payoffs, group, payoffs)
    for number, payoff in enumerate(payoffs, 1):   # one maximum for each round
        df = df.transform(add_group_maximum, group, payoff, pid, f"maximum{number}")
    df = attempts(df, id_col, [F.col("date").asc_nulls_last(), F.col(pid).asc()])
    df = df.transform(classify_validity, id_col, stage_cols, exclusions, pid)
    df = groups_with_valid(df, group, F.col("valid") == "yes").where(F.col("time_total").isNotNull())
    df = mask_where(df, F.col("invalid") != "", human)
    df = mask_where(df, F.col("time_total") < MIN_TOTAL_S, human)
    return df.drop(*private)


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """Members and completed members of each group that is left."""
    done = F.count_if(F.col("group_completed") == "Completed")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_members"), done.alias("n_completed"))
