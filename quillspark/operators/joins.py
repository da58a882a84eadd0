"""Joins (JN-*). All reference joins are equi-joins.

Only literal lookup tables, whose size is fixed in code, carry a broadcast
hint; everything else is left to the planner and AQE, which choose a
broadcast by the measured bytes of a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_back(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where a null key matches a null key, keeping the left side's key columns: for results
    per group that go back to the group's rows, of which none may get lost."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys]) if how != "left_semi" else left.join(named, on, how)


def lookup_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A literal lookup table (size fixed in code, so broadcast is safe)."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def left_null_safe(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """JN-01: left outer join where a null key matches a null key."""
    return left.join(right, left[lkey].eqNullSafe(right[rkey]), "left")


def with_group_agg(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """JN-02: per-group results attached to every row: a partial aggregate,
    one row per group, joined back null-safely, so that a group with a large
    share of the rows is never one window task."""
    return join_back(df, df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()]), keys)


def semi_by_term(items: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """JN-03 / SET-03: keep items listed in an index (order is not changed)."""
    return items.join(index.select(key).distinct(), on=key, how="left_semi")


def resolve_members(df: DataFrame, arr: str, dim: DataFrame, dim_key: str, dim_value: str, out: str) -> DataFrame:
    """JN-04: resolve each array member against a dimension, falling back to
    the raw value, preserving member order. One path for every size: equal
    arrays are resolved once, by a join on their members, and go back to all
    rows that hold them, so no row is lost (empty and null arrays stay as
    they are). A dimension key that repeats counts with its least value."""
    names = dim.groupBy(F.col(dim_key).cast("string").alias("_member")).agg(F.min(F.col(dim_value).cast("string")).alias("_name"))
    arrays = df.select(F.col(arr).alias("_arr")).where(F.size("_arr") > 0).distinct()
    res = (arrays.select("_arr", F.posexplode("_arr").alias("_pos", "_member")).join(names, on="_member", how="left")
           .groupBy("_arr").agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_name", "_member").alias("v")))).alias("_r"))
           .select("_arr", F.transform("_r", lambda x: x["v"]).alias("_res")))
    return (df.join(res, df[arr] == res["_arr"], "left").withColumn("_res", F.coalesce("_res", F.col(arr)))
              .drop("_arr").withColumn(out, F.col("_res")).drop("_res"))


def ordinal_lookup(df: DataFrame, code_col: str, ids: DataFrame, translations: DataFrame,
                   out: str) -> DataFrame:
    """JN-05: code -> id by list position, then id -> translation."""
    j = df.join(ids, df[code_col] == ids["pos"], "left").drop("pos")
    j = j.join(translations, on="label_id", how="left")
    return j.withColumnRenamed("translation", out)


def reconcile(master: DataFrame, child: DataFrame, key: str, value: str) -> DataFrame:
    """JN-06: master ids and order, child value where present, else master."""
    c = child.select(key, F.col(value).alias("_child"))
    return (master.join(c, on=key, how="left")
                  .withColumn(value, F.coalesce("_child", value)).drop("_child"))


def through_array(items: DataFrame, item_key: str, refs: str, targets: DataFrame,
                  target_key: str) -> DataFrame:
    """JN-07: many-to-many through an array of references; unmatched
    references are dropped (inner join). Reverse direction: swap roles."""
    ex = items.select(item_key, F.explode(refs).alias(target_key))
    return ex.join(targets, on=target_key, how="inner")


def two_key_lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """JN-08: left lookup of one value on a composite key (the lookup side
    is joined as is: the planner / AQE decide whether it is broadcast)."""
    t = table.select(*keys, F.col(value).alias(out))
    return df.join(t, on=keys, how="left")


def nest_children(parents: DataFrame, children: DataFrame, parent_key: str, weight: str,
                  fields: list[str], out: str) -> DataFrame:
    """JN-09: children grouped under their parent, ordered by weight."""
    kids = (children.groupBy(parent_key)
                    .agg(F.array_sort(F.collect_list(F.struct(weight, *fields))).alias(out)))
    return parents.join(kids, on=parent_key, how="left")


def lookup_with_default(df: DataFrame, key: str, table: DataFrame, value: str, default) -> DataFrame:
    """JN-10: configuration lookup by name with a default."""
    t = table.select(F.col(table.columns[0]).alias(key), F.col(value).alias("_v"))
    return df.join(t, on=key, how="left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v")


def sibling_classes(df: DataFrame, id_col: str, key: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """JN-11 for all siblings: rows of one content form a class, named by its smallest id. Returns the membership (id, lang,
    class_id), by which every sibling of a row is found, and the classes (class_id, n, languages: each with its number of
    rows; an unknown language is one like others). Pairs, which grow with the square of a class, are never listed. Rows
    without a key are one class."""
    slim = df.select(id_col, key, lang)
    named = slim.groupBy(key).agg(F.min(id_col).alias("class_id"))
    members = join_back(slim, named, [key]).select(id_col, lang, "class_id")
    counts = members.groupBy("class_id", lang).agg(F.count(F.lit(1)).alias("n_lang"))
    classes = counts.groupBy("class_id").agg(F.sum("n_lang").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(lang).alias("lang"), "n_lang"))).alias("languages"))
    return members, classes


def translations(df: DataFrame, id_col: str, key: str, lang: str, out: str) -> DataFrame:
    """JN-11: for each row, the other languages its content exists in, each
    with its representative (lowest id); an unknown language is one like
    others. Computed from the per-key language set (bounded by the number of
    languages), never from row pairs; ``sibling_classes`` leads to all
    siblings. Rows without a key are one group, as elsewhere."""
    reps = df.groupBy(key, lang).agg(F.min(id_col).alias("_rep"))
    per_key = reps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(lang, "_rep"))).alias("_langs"))
    j = join_back(df.select(id_col, key, lang), per_key, [key])
    return j.select(id_col, F.filter("_langs", lambda x: ~x[lang].eqNullSafe(F.col(lang))).alias(out))
