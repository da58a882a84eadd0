"""SRT-*: sorts, limits, top-k."""

from pyspark.sql import functions as F

from quillspark.operators import sorting as S
from quillspark.operators.aggregates import term_counts
from quillspark.plans.registry import register
from quillspark.plans.tables import table


@register("srt-01", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def srt_01(spark, d):
    return S.by_date(table(spark, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@register("srt-02", """
SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5 OFFSET 20""")
def srt_02(spark, d):
    o = S.by_date(table(spark, d, "orders"), "o_orderdate", "o_orderkey")
    return S.page_slice(o, offset=20).select("o_orderkey")


@register("srt-03", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def srt_03(spark, d):
    o = table(spark, d, "orders")
    return S.first_n(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 7).select("o_orderkey", "o_totalprice")


@register("srt-04", """
SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_quantity DESC, l_linenumber DESC,
                              l_returnflag DESC) AS lines_by_qty FROM lineitem GROUP BY l_orderkey""")
def srt_04(spark, d):
    li = table(spark, d, "lineitem")
    nested = li.groupBy("l_orderkey").agg(
        F.collect_list(F.struct("l_quantity", "l_linenumber", "l_returnflag")).alias("lines"))
    return nested.select("l_orderkey", F.array_join(F.transform(
        S.sort_nested("lines", desc=True), lambda x: x["l_linenumber"].cast("string")), ",").alias("lines_by_qty"))


@register("srt-05", """
SELECT term, n FROM (SELECT lower(unnest(regexp_split_to_array(p_name, ' '))) AS term, count(*) AS n
                     FROM part GROUP BY term ORDER BY n DESC, term LIMIT 5) ORDER BY term""")
def srt_05(spark, d):
    counts = term_counts(table(spark, d, "part"), F.split("p_name", " "))
    return S.top_then_alpha(counts, 5, "n", "term")


@register("srt-06", """
SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name DESC) AS pos FROM nation""")
def srt_06(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return S.ranked(n, S.by_weight_or_name(True, "n_nationkey", "n_name"))


@register("srt-07", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC,
       l_linenumber, l_returnflag, l_partkey) AS pos FROM lineitem""")
def srt_07(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_partkey")
    return S.within_groups(li, "l_orderkey", [F.col("l_extendedprice").desc(), "l_linenumber", "l_returnflag",
                                              "l_partkey"]).select("l_orderkey", "l_linenumber", "pos")


@register("srt-08", """
SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS pos FROM events""")
def srt_08(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts")
    return S.ranked(ev, [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "pos")


@register("srt-09", """
SELECT s_id, row_number() OVER (ORDER BY TRY_CAST(s_id AS BIGINT)) AS pos
FROM (SELECT CAST(s_suppkey AS VARCHAR) AS s_id FROM supplier)""")
def srt_09(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("s_id"))
    return S.ranked(s, [S.numeric_id_order("s_id")])


@register("srt-10", """
SELECT c_custkey, row_number() OVER (ORDER BY (c_mktsegment || ' ' || c_name) COLLATE en, c_custkey) AS pos
FROM customer""")
def srt_10(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("key"))
    return S.ranked(c, [S.locale_key("key"), F.col("c_custkey")]).select("c_custkey", "pos")
