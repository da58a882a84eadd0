"""Null rules N1-N8 on hand-written frames (the test tables have no nulls)."""

from pyspark.sql import functions as F

from quillspark.functions import nulls as N


def test_n1_strict_sum(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (2, 3.0)], "g int, x double")
    out = dict(df.groupBy("g").agg(N.strict_sum("x").alias("s")).collect())
    assert out[1] is None and out[2] == 5.0


def test_n2_na_text_keeps_order(spark):
    from quillspark.operators.aggregates import ordered_concat
    df = spark.createDataFrame([(1, 2, None), (1, 1, "a"), (1, 3, "b")], "g int, o int, v string")
    assert df.groupBy("g").agg(ordered_concat("v", "o").alias("c")).first()["c"] == "aNAb"


def test_n3_null_safe_join(spark):
    from quillspark.operators.joins import left_null_safe
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "p"), (1, "q")], "k2 int, b string")
    got = sorted((r["a"], r["b"]) for r in left_null_safe(a, b, "k", "k2").collect())
    assert got == [("x", "p"), ("y", "q")]


def test_n4_mask_keeps_null_condition(spark):
    from quillspark.operators.projection import mask_where
    df = spark.createDataFrame([(None, 1), (True, 2), (False, 3)], "c boolean, v int")
    out = [r["v"] for r in mask_where(df, F.col("c"), ["v"]).orderBy(F.col("c").asc_nulls_first()).collect()]
    assert out == [1, 3, None]


def test_n5_not_true_keeps_absent(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "f boolean")
    assert df.where(N.is_not("f", True)).count() == 2


def test_n6_first_set_skips_empty(spark):
    df = spark.createDataFrame([("", None, "c"), ("a", "b", "c"), (None, "", "")], "a string, b string, c string")
    assert [r[0] for r in df.select(N.first_set("a", "b", "c")).collect()] == ["c", "a", ""]


def test_n7_desc_nulls_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r[0] for r in df.orderBy(N.desc_nulls_last("x")).collect()] == [2, 1, None]


def test_n8_tolerant_cast(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(N.tolerant("s", "int")).collect()] == [12, None, None]
