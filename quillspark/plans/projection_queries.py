"""PRJ-*: projections, selectors, renames, derived columns, masking."""

from pyspark.sql import functions as F

from quillspark.functions.text import auto_summary
from quillspark.operators import projection as P
from quillspark.plans.registry import register
from quillspark.plans.tables import table

FIRST_LINE = r"^[^\n]*"


@register("prj-01", """
SELECT l_orderkey, l_linenumber, l_discount, l_extendedprice, l_linestatus, l_partkey,
       l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax FROM lineitem""")
def prj_01(spark, d):
    return P.first_then_sorted(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("prj-02", "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM lineitem")
def prj_02(spark, d):
    return P.select_like(table(spark, d, "lineitem"), starts=("l_ship",), ends=("key",))


@register("prj-03", """
SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation_id,
       c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def prj_03(spark, d):
    return P.rename(table(spark, d, "customer"), {
        "c_custkey": "customer_id", "c_name": "name", "c_nationkey": "nation_id",
        "c_acctbal": "balance", "c_mktsegment": "segment"})


@register("prj-04", """
SELECT p_partkey AS partkey_1, p_name AS name_1, p_size AS size_2, p_brand AS "session.code",
       p_type AS "participant.type" FROM part""")
def prj_04(spark, d):
    wide = table(spark, d, "part").select(
        F.col("p_partkey").alias("matching.1.player.partkey"),
        F.col("p_name").alias("matching.1.player.name"),
        F.col("p_size").alias("matching.2.player.size"),
        F.col("p_brand").alias("session.code"),
        F.col("p_type").alias("participant.type"))
    return P.rename_by_rule(wide)


@register("prj-05", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
       CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_returnflag = 'R' AS is_returned
FROM lineitem""")
def prj_05(spark, d):
    li = table(spark, d, "lineitem")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return P.derive(li, {"revenue": rev, "charge": rev * (1 + F.col("l_tax")),
                         "ship_year": F.year("l_shipdate"),
                         "is_returned": F.col("l_returnflag") == "R"}
                    ).select("l_orderkey", "l_linenumber", "revenue", "charge", "ship_year", "is_returned")


@register("prj-06", """
SELECT o_orderkey, o_orderstatus,
       CASE WHEN NOT coalesce(o_orderstatus = 'P', false) THEN o_totalprice END AS o_totalprice,
       CASE WHEN NOT coalesce(o_orderstatus = 'P', false) THEN o_orderpriority END AS o_orderpriority
FROM orders""")
def prj_06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return P.mask_where(o, F.col("o_orderstatus") == "P", ["o_totalprice", "o_orderpriority"])


@register("prj-07", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def prj_07(spark, d):
    return P.publishable(table(spark, d, "customer"), ["c_name", "c_acctbal"])


@register("prj-08", r"""
SELECT doc_id, coalesce(nullif(summary, ''), nullif(abstract, ''),
                        array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:30], ' ')) AS description
FROM (SELECT doc_id, text,
             CASE WHEN length(regexp_extract(text, '^[^\n]*', 0)) <= 80 THEN regexp_extract(text, '^[^\n]*', 0) ELSE '' END AS summary,
             CASE WHEN lang = 'en' THEN regexp_extract(text, '^[^.]*\.', 0) ELSE '' END AS abstract
      FROM documents)""")
def prj_08(spark, d):
    docs = table(spark, d, "documents")
    first = F.regexp_extract("text", FIRST_LINE, 0)
    summary = F.when(F.length(first) <= 80, first).otherwise(F.lit(""))
    abstract = F.when(F.col("lang") == "en", F.regexp_extract("text", r"^[^.]*\.", 0)).otherwise(F.lit(""))
    return docs.select("doc_id", P.description(summary, abstract, auto_summary("text")).alias("description"))


@register("prj-09", """
SELECT page_id, coalesce(nullif(CASE WHEN url LIKE 'https://%' THEN url ELSE '' END, ''),
                         '/page/' || page_id) AS link FROM pages""")
def prj_09(spark, d):
    pages = table(spark, d, "pages")
    external = F.when(F.col("url").startswith("https://"), F.col("url")).otherwise(F.lit(""))
    own = F.concat(F.lit("/page/"), F.col("page_id").cast("string"))
    return pages.select("page_id", P.effective_link(external, own).alias("link"))
