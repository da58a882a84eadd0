"""FLT-*: filters."""

from pyspark.sql import functions as F

from quillspark.functions.boolquery import compile_query
from quillspark.operators import filters as FL
from quillspark.plans.registry import register
from quillspark.plans.tables import table


def _docs_labels(spark, d):
    return table(spark, d, "documents").select("doc_id").join(
        table(spark, d, "labels"), on="doc_id", how="left")


@register("flt-01", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def flt_01(spark, d):
    return FL.where_eq(table(spark, d, "orders"), o_orderstatus="F").select("o_orderkey", "o_orderstatus")


@register("flt-02", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL""")
def flt_02(spark, d):
    return FL.not_null(_docs_labels(spark, d), "quality").select("doc_id", "quality")


@register("flt-03", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def flt_03(spark, d):
    o = table(spark, d, "orders")
    return FL.where_eq(FL.where_eq(o, o_orderstatus="F"), o_orderpriority="1-URGENT").select("o_orderkey")


@register("flt-04", """
SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.toxic IS DISTINCT FROM 1""")
def flt_04(spark, d):
    return FL.not_value(_docs_labels(spark, d), "toxic", 1).select("doc_id", "toxic")


@register("flt-05", """
SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AS is_past FROM orders
WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'""")
def flt_05(spark, d):
    o = FL.relative_to(table(spark, d, "orders"), "o_orderdate", "1998-01-01 00:00:00", past=True)
    return o.select("o_orderkey", (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("is_past"))


@register("flt-06", """
SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_24')""")
def flt_06(spark, d):
    return FL.member_of(table(spark, d, "nation"), "n_name",
                        ["NATION_1", "NATION_3", "NATION_5", "NATION_24"]).select("n_nationkey", "n_name")


@register("flt-07", r"""
SELECT doc_id FROM documents
WHERE len(list_intersect(regexp_split_to_array(lower(text), '\s+'), ['the', 'und', 'la'])) > 0""")
def flt_07(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(FL.overlaps(F.split(F.lower("text"), r"\s+"), ["the", "und", "la"])).select("doc_id")


@register("flt-08", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)th[a-z]*ion')")
def flt_08(spark, d):
    return table(spark, d, "documents").where(FL.text_matches("text", "th[a-z]*ion")).select("doc_id")


@register("flt-09", """
SELECT o_orderkey FROM orders
WHERE year(o_orderdate) = 1997 AND regexp_matches(o_orderpriority, '(?i)urgent|high')""")
def flt_09(spark, d):
    o = table(spark, d, "orders")
    facet = {"type": None,   # "*": any
             "year": F.year("o_orderdate") == 1997,
             "text": FL.text_matches("o_orderpriority", "urgent|high")}
    return o.where(FL.facets(facet)).select("o_orderkey")


@register("flt-10", """
SELECT p_partkey FROM part WHERE replace(p_name, ' ', '-') = 'small-ring' OR p_type = 'small-ring'""")
def flt_10(spark, d):
    p = table(spark, d, "part")
    return p.where(FL.tag_class(F.array("p_name", "p_type"), "small-ring")).select("p_partkey")


@register("flt-11", """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE (l.toxic = 1) IS DISTINCT FROM true AND (l.quality = 0) IS DISTINCT FROM true""")
def flt_11(spark, d):
    dl = _docs_labels(spark, d)
    return dl.where(FL.visible(F.col("toxic") == 1, F.col("quality") == 0)).select("doc_id")


@register("flt-12", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00'""")
def flt_12(spark, d):
    ev = table(spark, d, "events")
    return ev.where(FL.time_range("ts", "2024-01-03 00:00:00", "not a date")).select("event_id")


@register("flt-13", """
SELECT event_id FROM events
WHERE (CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 THEN value END) IS NOT NULL""")
def flt_13(spark, d):
    ev = table(spark, d, "events")
    media = F.when(F.get_json_object("props", "$.k").cast("int") >= 90, F.col("value"))
    return ev.where(FL.presence(media, "with")).select("event_id")


@register("flt-14", """
SELECT doc_id FROM documents
WHERE (contains(lower(text), 'the') OR contains(lower(text), 'en la')) AND NOT contains(lower(text), 'und')""")
def flt_14(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(compile_query("text", '(the OR "en la") -und')).select("doc_id")


@register("flt-15", r"""
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)),
                   lambda x: NOT regexp_matches(x, '^(Le|La|The) ') AND length(x) > 0)) AS INTEGER) AS n_kept
FROM documents""")
def flt_15(spark, d):
    # each document's lines form a nested array; keep elements that do not match
    # the exclusion regex and carry the required (non-empty) field
    docs = table(spark, d, "documents")
    items = F.transform(F.split("text", "\n"), lambda l: F.struct(
        l.alias("text"), F.nullif(l, F.lit("")).alias("body")))
    return docs.select("doc_id", F.size(FL.keep_elements(items, "^(Le|La|The) ", ["body"])).alias("n_kept"))


@register("flt-16", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def flt_16(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return FL.groups_with_valid(li, "l_orderkey", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@register("flt-17", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def flt_17(spark, d):
    s = table(spark, d, "supplier").withColumn("enable", F.col("s_acctbal") > 0)
    return FL.active(s, "enable").select("s_suppkey")


# Per-priority defaults of the "show related" flag.
PRIORITY_DEFAULTS = [("1-URGENT", True), ("2-HIGH", True), ("3-MEDIUM", False),
                     ("4-NOT SPECIFIED", False), ("5-LOW", False)]


@register("flt-18", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN false END, dflt.flag) AS show_related
FROM orders LEFT JOIN (VALUES ('1-URGENT', true), ('2-HIGH', true), ('3-MEDIUM', false),
                              ('4-NOT SPECIFIED', false), ('5-LOW', false)) dflt(prio, flag)
  ON orders.o_orderpriority = dflt.prio""")
def flt_18(spark, d):
    o = table(spark, d, "orders").withColumn(
        "row_flag", F.when(F.col("o_orderstatus") == "P", F.lit(False)))
    defaults = spark.createDataFrame(PRIORITY_DEFAULTS, "prio string, flag boolean")
    out = FL.with_default_flag(o, "row_flag", "o_orderpriority", defaults, "show_related")
    return out.select("o_orderkey", "show_related")


@register("flt-16-null", """
SELECT l_orderkey, l_linenumber FROM (SELECT *, nullif(l_suppkey, 3) AS grp FROM lineitem) l
WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_returnflag = 'R' AND m.l_quantity > 49 AND nullif(m.l_suppkey, 3) IS NOT DISTINCT FROM l.grp)""")
def flt_16_null(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.nullif(F.col("l_suppkey"), F.lit(3).cast("bigint")).alias("grp"))
    return FL.groups_with_valid(li, "grp", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).select("l_orderkey", "l_linenumber")
