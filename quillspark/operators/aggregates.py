"""Aggregations (AGG-*). Aggregates use partial (map-side) aggregation;
ordered concatenation of large groups goes by segments of range-sorted rows,
nested lists are paged."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.nulls import na_text, strict_sum
from quillspark.functions.text import slug
from quillspark.operators.joins import join_back
from quillspark.operators.windows import concat_groups, row_number_scaled
from quillspark.session import materialize

CHUNK = 1_000   # values of a category in one list of the contingency grid


def count_per(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    """AGG-01 / AGG-02: count per (multi-key) group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def group_sum_on_rows(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """AGG-03: group sum written back to each row; null if any member is null (N1). A partial aggregate joined back."""
    total = F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))
    return join_back(df, df.groupBy(*keys).agg(total.alias(out)), keys)


def ordered_concat(value: str, order_by: str, sep: str = "") -> Column:
    """AGG-04 as an aggregate, for groups bounded by the data model; missing values appear as ``NA`` (N2)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("o"), na_text(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def ordered_concat_groups(df: DataFrame, keys: list[str], value: str, order_by: str, out: str, sep: str = "") -> DataFrame:
    """AGG-04: ordered concatenation per group, of any size; missing values appear as ``NA`` (N2)."""
    return concat_groups(df, keys, [order_by], na_text(value), out, sep)


def contingency(df: DataFrame, dims: list[str], out: str = "n", chunk: int = CHUNK) -> DataFrame:
    """AGG-05: 1- to k-way contingency table including zero cells.

    The grid has a row for each combination by definition; it is built by
    equi-joins on generated chunk numbers. A dimension's distinct values are
    dealt by hash into lists of about ``chunk`` values, each grid row asks
    for every list number and unfolds the list it meets, so no task or row
    holds a whole domain. Rows with a missing dimension value are not
    counted (as in ``table``)."""
    base = df.select(*dims).dropna()
    counts = base.groupBy(*dims).agg(F.count(F.lit(1)).alias(out))
    cells = materialize(counts, "cells")
    grid = cells.select(dims[0]).distinct()
    for d in dims[1:]:
        values = cells.select(d).distinct()
        n = values.select(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("n")).scalar()
        lists = values.withColumn("_n", n).groupBy(F.pmod(F.xxhash64(d), F.col("_n")).cast("int").alias("_chunk")).agg(F.collect_list(d).alias("_values"))
        asked = grid.withColumn("_n", n).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        grid = asked.join(lists, on="_chunk").withColumn(d, F.explode("_values")).drop("_chunk", "_values")
    return grid.join(cells, on=dims, how="left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def contingency_display(df: DataFrame, row: str, col: str, block: int = 50) -> Iterator[DataFrame]:
    """AGG-05 as shown: a row per value of ``row``, a column per value of ``col``, cells counted, zero cells 0. The columns are
    found at run time, in order, and shown in blocks of at most ``block`` of them, one table a block (an unbounded domain never
    is one table's columns, and no more than a block of names is on the driver). Every block has all rows."""
    base = df.select(row, col).dropna()
    counts = materialize(base.groupBy(row, col).agg(F.count(F.lit(1)).alias("n")), "cells")
    names, last = counts.select(col).distinct(), None
    while True:
        found = [r[0] for r in (names if last is None else names.where(F.col(col) > F.lit(last))).orderBy(col).limit(block).collect()]
        if not found:
            return
        cells = [F.coalesce(F.sum(F.when(F.col(col) == F.lit(v), F.col("n"))), F.lit(0)).alias(str(v)) for v in found]
        yield counts.groupBy(row).agg(*cells)
        last = found[-1]


def pivot_first(df: DataFrame, id_col: str, key_col: str, values: list[str], ts_col: str,
                prefix: str) -> DataFrame:
    """AGG-06: long to wide with explicit values (no extra job to find them);
    duplicate (id, key) rows keep the earliest timestamp."""
    wide = df.groupBy(id_col).pivot(key_col, values).agg(F.min(ts_col))
    return wide.withColumnsRenamed({v: f"{prefix}{v}" for v in values})


def group_size(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """AGG-07: group size as a column. Counted with a partial (map-side)
    aggregate and joined back, so a key holding a large share of the rows
    is never one window task; the count side has one row per key (AQE may
    broadcast it, and skew-join splitting covers the row side)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return join_back(df, sizes, keys)


def top_n_sum(df: DataFrame, keys: list[str], value: str, tie: str, n: int = 2, plus: float = 0.0,
              out: str = "total") -> DataFrame:
    """AGG-08: sum of the ``n`` largest values per group plus a constant (N1).
    ``row_number() <= n`` lets Spark cut each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), F.col(tie))
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy(*keys).agg((strict_sum(value) + F.lit(plus)).alias(out))


def term_counts(df: DataFrame, arr: Column, out_term: str = "term", out: str = "n") -> DataFrame:
    """AGG-09: exploded array terms, slugged (case folded), counted."""
    ex = df.select(F.explode(arr).alias("_t")).select(slug(F.col("_t")).alias(out_term))
    return ex.where(F.col(out_term) != "").groupBy(out_term).agg(F.count(F.lit(1)).alias(out))


def grouped_by_year(df: DataFrame, date_col: str, out_year: str = "year", out_n: str = "n_in_year") -> DataFrame:
    """AGG-10: rows grouped under their year with the group size; the
    grouping is a sort key, not a nested list, so a large year never has to
    fit in one row."""
    y = df.withColumn(out_year, F.year(date_col))
    sizes = y.groupBy(out_year).agg(F.count(F.lit(1)).alias(out_n))
    return join_back(y, sizes, [out_year])


def nested_by_date(df: DataFrame, date_col: str, id_col: str, pattern: str, fields: list[str], page: int = 100) -> DataFrame:
    """AGG-10, nested: under each formatted date its rows, newest first, as pages of at most ``page`` rows: (group, page from 1,
    n_in_group, items). Pages bound what a row holds, whatever a group's size; positions come from the segmented numbering."""
    g = df.withColumns({"group": F.date_format(date_col, pattern), "_fields": F.struct(*fields)}).select("group", date_col, id_col, "_fields")
    sizes = g.groupBy("group").agg(F.count(F.lit(1)).alias("n_in_group"))
    placed = row_number_scaled(g, [F.col(date_col).desc(), F.col(id_col).desc()], keys=["group"], out="_rn")
    paged = placed.withColumn("page", F.floor((F.col("_rn") - 1) / F.lit(page)).cast("int") + 1)
    lists = paged.groupBy("group", "page").agg(F.array_sort(F.collect_list(F.struct("_rn", "_fields"))).alias("_items"))
    out = join_back(lists, sizes, ["group"])
    return out.select("group", "page", "n_in_group", F.transform("_items", lambda x: x["_fields"]).alias("items"))


def distinct_desc(df: DataFrame, col: Column, out: str) -> DataFrame:
    """AGG-11."""
    return df.select(col.alias(out)).distinct().orderBy(F.col(out).desc())


def total_of(df: DataFrame) -> Column:
    """AGG-12: the row count as a scalar subquery (no global window)."""
    return df.select(F.count(F.lit(1))).scalar()


def tolerant_sum(x) -> Column:
    """AGG-13: sum of counts held as text; unparsable values count 0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(F.coalesce(x.try_cast("int"), F.lit(0))).cast("bigint")


def min_max_scaled(df: DataFrame, col: str, out: str) -> DataFrame:
    """AGG-14: scaling by the global min and max (two scalar subqueries)."""
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    return df.withColumn(out, (F.col(col) - lo) / F.nullif(hi - lo, F.lit(0)))


def count_labels(df: DataFrame, keys: list[str], labels: dict[str, Column]) -> DataFrame:
    """AGG-15: per group, how many rows carry each label (counted directly)."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in labels.items()])


def active_groups(df: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """AGG-18: groups with at least one non-empty message, latest activity first."""
    g = df.groupBy(group).agg(F.count_if(F.col(text) != "").alias("n_messages"), F.max(order).alias("last_turn"))
    return g.where(F.col("n_messages") > 0).orderBy(F.col("last_turn").desc(), group)


def best_by(value, *keys) -> Column:
    """AGG-16 / AGG-17: value of the row with the greatest key tuple
    (the last of equals wins when the tuple ends with a position)."""
    return F.max_by(value, F.struct(*keys))


def status_label(total: Column, zero: str = "Not yet", other: str = "Completed") -> Column:
    """AGG-19."""
    return F.when(total == 0, F.lit(zero)).otherwise(F.lit(other))
