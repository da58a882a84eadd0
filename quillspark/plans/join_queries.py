"""JN-*: joins."""

from pyspark.sql import functions as F

from quillspark.operators import joins as J
from quillspark.plans.registry import register
from quillspark.plans.tables import table


@register("jn-01", """
SELECT o.o_orderkey, c.c_name, c.c_nationkey FROM orders o
LEFT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""")
def jn_01(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    return J.left_null_safe(o, c, "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_nationkey")


@register("jn-02", """
SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS order_qty,
       CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS order_lines FROM lineitem""")
def jn_02(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return J.with_group_agg(li, ["l_orderkey"], {"order_qty": F.sum("l_quantity"),
                                                 "order_lines": F.count(F.lit(1))}).drop("l_quantity")


@register("jn-03", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def jn_03(spark, d):
    idx = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("o_custkey"))
    return J.semi_by_term(table(spark, d, "orders"), idx, "o_custkey").select("o_orderkey")


@register("jn-04", """
SELECT a.doc_id, string_agg(coalesce(n.n_name, a.author), '; ' ORDER BY a.pos) AS authors
FROM (SELECT doc_id, unnest([source, lang]) AS author, unnest([0, 1]) AS pos FROM documents) a
LEFT JOIN nation n ON 'src' || CAST(n.n_nationkey AS VARCHAR) = a.author
GROUP BY a.doc_id""")
def jn_04(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("source", "lang").alias("authors"))
    dim = table(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("slug"), "n_name")
    r = J.resolve_members(docs, "authors", dim, "slug", "n_name", "resolved")
    return r.select("doc_id", F.array_join("resolved", "; ").alias("authors"))


# Publication type ids by list position, and their English labels.
PUB_TYPES = ["pub_uncat", "pub_conf", "pub_journal", "pub_preprint", "pub_report",
             "pub_book", "pub_book_section", "pub_thesis", "pub_patent"]
PUB_LABELS = [("pub_uncat", "Uncategorized"), ("pub_conf", "Conference paper"),
              ("pub_journal", "Journal article"), ("pub_preprint", "Preprint"),
              ("pub_report", "Report"), ("pub_book", "Book"), ("pub_book_section", "Book section"),
              ("pub_thesis", "Thesis"), ("pub_patent", "Patent")]

PUB_SQL_IDS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(PUB_TYPES))
PUB_SQL_LABELS = ", ".join(f"('{a}', '{b}')" for a, b in PUB_LABELS)


@register("jn-05", f"""
SELECT p_partkey, CAST((p_size - 1) // 6 AS INTEGER) AS pub_type, t.translation AS type_label
FROM part LEFT JOIN (VALUES {PUB_SQL_IDS}) ids(pos, label_id) ON (p_size - 1) // 6 = ids.pos
LEFT JOIN (VALUES {PUB_SQL_LABELS}) t(label_id, translation) ON ids.label_id = t.label_id""")
def jn_05(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.floor((F.col("p_size") - 1) / 6).cast("int").alias("pub_type"))
    ids = J.lookup_table(spark, list(enumerate(PUB_TYPES)), "pos int, label_id string")
    tr = J.lookup_table(spark, PUB_LABELS, "label_id string, translation string")
    return J.ordinal_lookup(p, "pub_type", ids, tr, "type_label").select("p_partkey", "pub_type", "type_label")


@register("jn-06", """
SELECT n_nationkey, coalesce(s.child, n.n_name) AS n_name FROM nation n
LEFT JOIN (SELECT s_nationkey, min(s_name) AS child FROM supplier GROUP BY s_nationkey) s
  ON n.n_nationkey = s.s_nationkey""")
def jn_06(spark, d):
    master = table(spark, d, "nation").select("n_nationkey", "n_name")
    child = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")) \
        .agg(F.min("s_name").alias("n_name"))
    return J.reconcile(master, child, "n_nationkey", "n_name")


@register("jn-07", """
SELECT o.o_orderkey, c.c_custkey, c.c_name
FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 100000000]) AS c_custkey FROM orders) o
JOIN customer c ON o.c_custkey = c.c_custkey""")
def jn_07(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.array("o_custkey", F.col("o_custkey") + 100000000).alias("refs"))
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return J.through_array(o, "o_orderkey", "refs", c, "c_custkey").select("o_orderkey", "c_custkey", "c_name")


@register("jn-08", """
SELECT l.l_orderkey, l.l_linenumber, p.p_name AS caption FROM lineitem l
LEFT JOIN part p ON l.l_partkey = p.p_partkey AND l.l_linenumber = p.p_size""")
def jn_08(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    cap = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"),
                                         F.col("p_size").alias("l_linenumber"), F.col("p_name").alias("caption"))
    return J.two_key_lookup(li, cap, ["l_partkey", "l_linenumber"], "caption", "caption") \
        .select("l_orderkey", "l_linenumber", "caption")


@register("jn-09", """
SELECT r.r_name, string_agg(n.n_name, ',' ORDER BY n.n_nationkey) AS children
FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
def jn_09(spark, d):
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    n = table(spark, d, "nation")
    nested = J.nest_children(r, n, "n_regionkey", "n_nationkey", ["n_name"], "kids")
    return nested.select("r_name", F.array_join(F.transform("kids", lambda k: k["n_name"]), ",").alias("children"))


# Address format per region, default "en-us".
REGION_FORMATS = [("EUROPE", "de"), ("ASIA", "zh"), ("AMERICA", "en-us")]


@register("jn-10", """
SELECT n.n_nationkey, coalesce(f.fmt, 'en-us') AS address_format FROM nation n
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (VALUES ('EUROPE', 'de'), ('ASIA', 'zh'), ('AMERICA', 'en-us')) f(r_name, fmt) ON r.r_name = f.r_name""")
def jn_10(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"),
                                       on="n_regionkey")
    fmts = J.lookup_table(spark, REGION_FORMATS, "r_name string, address_format string")
    return J.lookup_with_default(n, "r_name", fmts, "address_format", "en-us").select("n_nationkey", "address_format")


@register("jn-11", """
WITH reps AS (SELECT source, lang, min(doc_id) AS rep FROM documents GROUP BY source, lang)
SELECT d.doc_id, coalesce(string_agg(coalesce(r.lang, '?') || ':' || CAST(r.rep AS VARCHAR), ',' ORDER BY r.lang NULLS FIRST), '') AS translations
FROM documents d LEFT JOIN reps r ON d.source IS NOT DISTINCT FROM r.source AND r.lang IS DISTINCT FROM d.lang AND r.rep IS NOT NULL
GROUP BY d.doc_id""")
def jn_11(spark, d):
    docs = table(spark, d, "documents")
    t = J.translations(docs, "doc_id", "source", "lang", "others")
    return t.select("doc_id", F.array_join(F.transform(
        "others", lambda x: F.concat(F.coalesce(x["lang"], F.lit("?")), F.lit(":"), x["_rep"].cast("string"))), ",").alias("translations"))


@register("jn-11-class", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN source END AS source, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang FROM documents),
c AS (SELECT source, min(doc_id) AS class_id, count(*) AS n, count(DISTINCT lang) + CAST(bool_or(lang IS NULL) AS INTEGER) AS n_languages FROM d GROUP BY source)
SELECT d.doc_id, d.lang, c.class_id, c.n, CAST(c.n_languages AS INTEGER) AS n_languages FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source""")
def jn_11_class(spark, d):
    """Membership beside its class; some rows have no key, some no language."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(i % 7 > 0, F.col("source")).alias("source"), F.when(i % 5 > 0, F.col("lang")).alias("lang"))
    members, classes = J.sibling_classes(docs, "doc_id", "source", "lang")
    return members.join(classes, "class_id").select("doc_id", "lang", "class_id", "n", F.size("languages").alias("n_languages"))


@register("jn-07-reverse", """
SELECT c.c_custkey, o.o_orderkey, o.o_orderstatus
FROM customer c JOIN (SELECT o_orderkey, o_orderstatus, unnest([o_custkey, o_custkey + 1]) AS c_custkey FROM orders) o ON o.c_custkey = c.c_custkey""")
def jn_07_reverse(spark, d):
    """The items that refer to a target, by type (orders by status of each customer)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.array("o_custkey", F.col("o_custkey") + 1).alias("refs"))
    c = table(spark, d, "customer").select("c_custkey")
    by_ref = o.select("o_orderkey", "o_orderstatus", F.explode("refs").alias("c_custkey"))
    return J.semi_by_term(by_ref, c, "c_custkey").select("c_custkey", "o_orderkey", "o_orderstatus")
