"""Window operators (WIN-*).

``row_number_scaled`` numbers rows in a total order (optionally per key)
without a single-partition window: a range-partitioned sort spreads even a
hot key over many tasks, each row is tagged with its partition and position,
the tagged data is written once to the shared checkpoint folder (so both
uses see the same rows and the sort runs once), and
per-(partition, key) counts -- one row per segment -- give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.joins import join_back
from quillspark.session import materialize

_LOW33 = (1 << 33) - 1
#: Rows of a group from which its ordered concatenation is spread over many tasks.
HOT_GROUP = 10_000


def segments(df: DataFrame, order: list[Column], keys: list[str] | None = None,
             name: str = "segments") -> DataFrame:
    """Range-sort by ``keys`` + ``order`` and tag each row with its sort
    partition (``_pid``) and position inside it (``_loc``). The tagged rows
    are written once, so every later use sees the same rows and ids. A key
    spread over several partitions forms several (``_pid``, key) segments,
    each at most one partition long."""
    keys = keys or []
    sort_keys = [F.col(k).asc() for k in keys] + order
    tagged = df.orderBy(*sort_keys).withColumn("_mid", F.monotonically_increasing_id())
    tagged = materialize(tagged, name)
    return tagged.withColumns({"_pid": F.shiftright("_mid", 33), "_loc": F.col("_mid").bitwiseAND(_LOW33)}) \
                 .drop("_mid")


def _segment_window(keys: list[str]) -> Window:
    return Window.partitionBy("_pid", *keys).orderBy("_loc")


def _across(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_pid")


def row_number_scaled(df: DataFrame, order: list[Column], keys: list[str] | None = None,
                      out: str = "rn") -> DataFrame:
    keys = keys or []
    tagged = segments(df, order, keys, "numbered")
    seg = tagged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_loc").alias("_first"))
    w = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    joined = join_back(tagged, seg, ["_pid", *keys])
    return joined.withColumn(out, F.col("_off") + F.col("_loc") - F.col("_first") + 1) \
                 .drop("_pid", "_loc", "_first", "_off")


def prev_next_scaled(tagged: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``prev_<c>`` / ``next_<c>`` within each key over segmented rows
    (see ``segments``): a window per segment, and for a segment's first and
    last rows the neighbouring segment's boundary values."""
    w = _segment_window(keys)
    x = tagged.withColumns({**{f"prev_{c}": F.lag(c).over(w) for c in cols},
                            **{f"next_{c}": F.lead(c).over(w) for c in cols}})
    seg = tagged.groupBy("_pid", *keys).agg(
        F.min("_loc").alias("_first"), F.max("_loc").alias("_last"),
        *[F.max_by(c, "_loc").alias(f"_lv_{c}") for c in cols],
        *[F.min_by(c, "_loc").alias(f"_fv_{c}") for c in cols])
    a = _across(keys)
    seg = seg.withColumns({**{f"_pv_{c}": F.lag(f"_lv_{c}").over(a) for c in cols},
                           **{f"_nv_{c}": F.lead(f"_fv_{c}").over(a) for c in cols}})
    seg = seg.select("_pid", *keys, "_first", "_last", *[f"_pv_{c}" for c in cols], *[f"_nv_{c}" for c in cols])
    x = join_back(x, seg, ["_pid", *keys])
    fixed = {}
    for c in cols:
        fixed[f"prev_{c}"] = F.when(F.col("_loc") == F.col("_first"), F.col(f"_pv_{c}")).otherwise(F.col(f"prev_{c}"))
        fixed[f"next_{c}"] = F.when(F.col("_loc") == F.col("_last"), F.col(f"_nv_{c}")).otherwise(F.col(f"next_{c}"))
    return x.withColumns(fixed).drop("_first", "_last", *[f"_pv_{c}" for c in cols], *[f"_nv_{c}" for c in cols])


def running_sum_scaled(tagged: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` within each key over segmented rows: a
    per-segment running sum plus the totals of the key's earlier segments."""
    x = tagged.withColumn("_v", value)
    w = _segment_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_rs", F.sum("_v").over(w))
    seg = x.groupBy("_pid", *keys).agg(F.sum("_v").alias("_segsum"))
    seg = seg.withColumn("_off", F.coalesce(F.sum("_segsum").over(
        _across(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_segsum")
    x = join_back(x, seg, ["_pid", *keys])
    return x.withColumn(out, F.col("_rs") + F.col("_off")).drop("_v", "_rs", "_off")


def attempts(df: DataFrame, id_col: str, order: list[Column], out: str = "attempt") -> DataFrame:
    """WIN-01: attempt number per id by time; a blank id is always attempt 1,
    a missing one falls through to the row number among the missing ones.
    All rows go through one numbering pass (blank ids form one key, possibly
    huge, which the segmented numbering spreads over many tasks); blanks are
    then set to 1. No branch re-reads the input."""
    numbered = row_number_scaled(df, order, keys=[id_col], out=out)
    return numbered.withColumn(out, F.when(F.col(id_col) == "", F.lit(1).cast("bigint")).otherwise(F.col(out)))


def duplicate_flag(attempt: Column, id_col: str) -> Column:
    """WIN-02: second and later attempts of a non-blank id."""
    return F.when((F.col(id_col) != "") & (attempt > 1), F.lit("True")).otherwise(F.lit("False"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-03: first row per group (Spark plans a per-group limit before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def concat_groups(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, sep: str = "", hot: int = HOT_GROUP) -> DataFrame:
    """One row per group with its values joined in order (``value`` breaks ties). Groups of up to ``hot`` rows are sorted
    within an aggregate. Larger ones are range-sorted over many tasks first: each segment, a part of one group in one task,
    joins its own rows, and the group joins its segments' texts, one a task."""
    narrow = df.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], value.alias("_v"))
    orders = [f"_o{i}" for i in range(len(order))]
    joined = lambda fields: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields, "_v"))), lambda p: p["_v"]), sep)
    large = materialize(narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot), "large-groups")
    if large.isEmpty():
        return narrow.groupBy(*keys).agg(joined(orders).alias(out))
    marked = join_back(narrow, large, keys)
    small = marked.where("_n is null").groupBy(*keys).agg(joined(orders).alias(out))
    t = segments(marked.where("_n is not null").drop("_n"), [F.col(o).asc() for o in [*orders, "_v"]], keys, "concat")
    parts = t.groupBy("_pid", *keys).agg(joined(["_loc"]).alias("_v"))
    return small.unionByName(parts.groupBy(*keys).agg(joined(["_pid"]).alias(out)))


def duplicate_groups(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """WIN-04, a row per group: its size, its values concatenated in order (missing as ``NA``) and whether it is exactly
    two equal values (a missing value equals ``NA``). The text is held once a group."""
    vals = F.coalesce(F.col(value).cast("string"), F.lit("NA"))
    n = F.count(F.lit(1))
    sizes = df.groupBy(*keys).agg(n.alias("n"), F.when((n == 2) & (F.min(vals) == F.max(vals)), 1).otherwise(0).alias("dup_equal"))
    texts = concat_groups(df, keys, order, vals, "flags_concat")
    return join_back(texts, sizes, keys).select(*keys, "n", "flags_concat", "dup_equal")


def duplicate_report(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """WIN-04: ``duplicate_groups`` shown beside every row of the group (for groups small enough to show)."""
    return join_back(df, duplicate_groups(df, keys, value, order), keys)


def bursts(df: DataFrame, conv: str, sender: str, ts: str, tie: str, gap_ms: int,
           skew_safe: bool = True) -> DataFrame:
    """WIN-05: rapid-fire runs: consecutive messages of one sender at most
    ``gap_ms`` apart (inclusive). Adds burst_id (per conversation), in_burst,
    is_first, is_last.

    With ``skew_safe`` (default) a conversation holding a large share of all
    rows is split over range-sorted segments instead of one window task."""
    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))

    def linked(prev_sender, prev_ts, cur_sender, cur_ts):
        return F.coalesce((prev_sender == cur_sender) & ((micros(cur_ts) - micros(prev_ts)) / 1000 <= gap_ms),
                          F.lit(False))

    if skew_safe:
        cols = [ts] if sender == conv else [ts, sender]
        t = segments(df, [F.col(ts).asc(), F.col(tie).asc()], [conv], "bursts")
        x = prev_next_scaled(t, [conv], cols)
        ps = F.col(f"prev_{sender}") if sender != conv else F.col(conv)
        ns = F.col(f"next_{sender}") if sender != conv else F.col(conv)
        has_prev, has_next = F.col(f"prev_{ts}").isNotNull(), F.col(f"next_{ts}").isNotNull()
        x = x.withColumns({"_link": has_prev & linked(ps, F.col(f"prev_{ts}"), F.col(sender), F.col(ts)),
                           "_next_link": has_next & linked(F.col(sender), F.col(ts), ns, F.col(f"next_{ts}"))})
        x = running_sum_scaled(x, [conv], (~F.col("_link")).cast("int"), "burst_id")
        x = x.drop("_pid", "_loc", *[f"prev_{c}" for c in cols], *[f"next_{c}" for c in cols])
    else:
        w = Window.partitionBy(conv).orderBy(ts, tie)
        x = df.withColumn("_link", linked(F.lag(sender).over(w), F.lag(ts).over(w), F.col(sender), F.col(ts)))
        x = x.withColumn("_next_link", F.coalesce(F.lead("_link").over(w), F.lit(False)))
        x = x.withColumn("burst_id", F.sum((~F.col("_link")).cast("int")).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
    return (x.withColumn("burst_id", F.col("burst_id").cast("bigint"))
             .withColumns({"in_burst": F.col("_link") | F.col("_next_link"),
                           "is_first": F.col("_next_link") & ~F.col("_link"),
                           "is_last": F.col("_link") & ~F.col("_next_link")})
             .drop("_link", "_next_link"))


def neighbours(df: DataFrame, section: str, order: list[str], value: str, swap: Column | None = None,
               skew_safe: bool = True) -> DataFrame:
    """WIN-06: previous / next item in a section; ``swap`` exchanges the two
    labels (documentation sections read forward)."""
    if skew_safe:
        t = segments(df, [F.col(o).asc() for o in order], [section], "neighbours")
        x = prev_next_scaled(t, [section], [value]).drop("_pid", "_loc")
        prev, nxt = F.col(f"prev_{value}"), F.col(f"next_{value}")
        if swap is not None:
            prev, nxt = F.when(swap, nxt).otherwise(prev), F.when(swap, prev).otherwise(nxt)
        return x.withColumns({"prev": prev, "next": nxt}).drop(f"prev_{value}", f"next_{value}")
    w = Window.partitionBy(section).orderBy(*order)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    if swap is None:
        return df.withColumns({"prev": prev, "next": nxt})
    return df.withColumns({"prev": F.when(swap, nxt).otherwise(prev),
                           "next": F.when(swap, prev).otherwise(nxt)})


def paginate(df: DataFrame, order: list[Column], page_size: int = 10) -> DataFrame:
    """WIN-07: page number and has-previous / has-next flags."""
    total = df.select(F.count(F.lit(1))).scalar()
    n = row_number_scaled(df, order, out="_rn")
    pages = F.ceil(total / F.lit(page_size))
    return (n.withColumn("page", F.ceil(F.col("_rn") / F.lit(page_size)).cast("bigint"))
             .withColumns({"has_prev": F.col("page") > 1, "has_next": F.col("page") < pages})
             .drop("_rn"))


def positions(df: DataFrame, keys: list[str], order: list[str], skew_safe: bool = False) -> DataFrame:
    """WIN-08 / WIN-09: first, not-last and alternate-row flags within groups.
    With ``skew_safe`` the row numbers come from ``row_number_scaled`` and
    the group sizes from a partial aggregate, so a huge group is spread over
    many tasks; without it, one window per group (for bounded groups)."""
    if skew_safe:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        x = row_number_scaled(df, [F.col(o).asc() for o in order], keys=keys, out="_rn")
        x = join_back(x, n, keys)
        rn, cnt = F.col("_rn"), F.col("_n")
    else:
        x = df
        rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        cnt = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = x.withColumns({"is_first": rn == 1, "not_last": rn < cnt, "is_odd": F.pmod(rn, F.lit(2)) == 1})
    return out.drop("_rn", "_n") if skew_safe else out


def stage_durations(df: DataFrame, key: str, ts: str, tie: str, out: str = "duration_s",
                    skew_safe: bool = True) -> DataFrame:
    """WIN-10 (long form): seconds from each milestone to the next of the same key."""
    def micros(c):
        return F.unix_micros(c.cast("timestamp"))
    if skew_safe:
        t = segments(df, [F.col(ts).asc(), F.col(tie).asc()], [key], "durations")
        x = prev_next_scaled(t, [key], [ts])
        return x.withColumn(out, (micros(F.col(f"next_{ts}")) - micros(F.col(ts))) / 1e6) \
                .drop("_pid", "_loc", f"prev_{ts}", f"next_{ts}")
    w = Window.partitionBy(key).orderBy(ts, tie)
    return df.withColumn(out, (micros(F.lead(ts).over(w)) - micros(F.col(ts))) / 1e6)
