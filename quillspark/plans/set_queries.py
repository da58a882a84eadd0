"""SET-*: set operations."""

from pyspark.sql import functions as F

from quillspark.operators import setops as SO
from quillspark.plans.registry import register
from quillspark.plans.tables import table


@register("set-01", "SELECT o_orderkey, o_custkey FROM orders")
def set_01(spark, d):
    o = table(spark, d, "orders")
    early = o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    late = o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("o_custkey", "o_orderkey")
    return SO.union_by_name(early, late)


@register("set-02", "SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier")
def set_02(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return SO.union_distinct(a, b, ["id"])


@register("set-03", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
                              AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def set_03(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    m = c.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    p = c.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    return SO.intersect_on(SO.intersect_on(o, m, ["o_custkey"]), p, ["o_custkey"]).select("o_orderkey")


@register("set-04", """
SELECT l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
FROM lineitem""")
def set_04(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(*SO.columns_except(li, ["l_orderkey", "l_linenumber", "l_shipdate"]))


@register("set-05", """
SELECT c_custkey AS id, c_name AS name, 'direct' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, 'group' FROM supplier""")
def set_05(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return SO.tagged_union({"direct": a, "group": b})


@register("set-06", """
WITH a AS (SELECT doc_id, quality FROM labels WHERE quality > 1)
SELECT * FROM a UNION ALL
SELECT doc_id, CAST(NULL AS INTEGER) AS quality FROM documents WHERE (SELECT count(*) FROM a) = 0""")
def set_06(spark, d):
    a = table(spark, d, "labels").where(F.col("quality") > 1).select("doc_id", "quality")
    b = table(spark, d, "documents").select("doc_id", F.lit(None).cast("int").alias("quality"))
    return SO.fallback(a, b)
