"""AGG-*: aggregations."""

from pyspark.sql import functions as F

from quillspark.functions.nulls import strict_sum
from quillspark.operators import aggregates as A
from quillspark.plans.registry import register
from quillspark.plans.tables import table


@register("agg-01", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def agg_01(spark, d):
    return A.count_per(table(spark, d, "orders"), "o_orderstatus")


@register("agg-02", """
SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_linenumber, l_tax, count(*) AS n
FROM lineitem GROUP BY ALL""")
def agg_02(spark, d):
    li = table(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    return A.count_per(li, "l_returnflag", "l_linestatus", "ship_year", "l_linenumber", "l_tax")


@register("agg-03", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN count(l_quantity) OVER w = count(*) OVER w THEN sum(l_quantity) OVER w END AS order_qty
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def agg_03(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return A.group_sum_on_rows(li, ["l_orderkey"], "l_quantity", "order_qty").drop("l_quantity")


@register("agg-04", """
SELECT l_orderkey, string_agg(coalesce(l_returnflag, 'NA'), '' ORDER BY l_linenumber, coalesce(l_returnflag, 'NA')) AS flags
FROM lineitem GROUP BY l_orderkey""")
def agg_04(spark, d):
    return A.ordered_concat_groups(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber", "flags")


@register("agg-04-hot", """
SELECT l_linestatus, string_agg(coalesce(l_returnflag, 'NA'), '' ORDER BY l_orderkey, coalesce(l_returnflag, 'NA')) AS flags
FROM lineitem GROUP BY l_linestatus""")
def agg_04_hot(spark, d):
    """A few groups that hold all rows."""
    return A.ordered_concat_groups(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "l_orderkey", "flags")


@register("agg-05", """
WITH b AS (SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem),
grid AS (SELECT * FROM (SELECT DISTINCT l_returnflag FROM b), (SELECT DISTINCT l_linestatus FROM b),
                       (SELECT DISTINCT ship_year FROM b)),
c AS (SELECT l_returnflag, l_linestatus, ship_year, count(*) AS n FROM b GROUP BY ALL)
SELECT g.l_returnflag, g.l_linestatus, g.ship_year, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN c USING (l_returnflag, l_linestatus, ship_year)""")
def agg_05(spark, d):
    li = table(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    return A.contingency(li, ["l_returnflag", "l_linestatus", "ship_year"])


@register("agg-05-display", """
SELECT doc_id % 97 AS bucket, """ + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + """
FROM documents WHERE lang IS NOT NULL GROUP BY doc_id % 97""")
def agg_05_display(spark, d):
    """Buckets of documents by language: the languages fit one block; many cells are empty."""
    docs = table(spark, d, "documents").select((F.col("doc_id") % 97).alias("bucket"), "lang")
    return next(A.contingency_display(docs, "bucket", "lang"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("agg-06", """
SELECT user_id, min(ts) FILTER (WHERE event_type = 'click') AS page_click,
       min(ts) FILTER (WHERE event_type = 'error') AS page_error,
       min(ts) FILTER (WHERE event_type = 'purchase') AS page_purchase,
       min(ts) FILTER (WHERE event_type = 'signup') AS page_signup,
       min(ts) FILTER (WHERE event_type = 'view') AS page_view
FROM events GROUP BY user_id""")
def agg_06(spark, d):
    return A.pivot_first(table(spark, d, "events"), "user_id", "event_type", EVENT_TYPES, "ts", "page_")


@register("agg-07", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def agg_07(spark, d):
    return A.group_size(table(spark, d, "events").select("event_id", "user_id"), ["user_id"])


@register("agg-08", """
SELECT l_orderkey, round(sum(l_extendedprice) + 600, 2) AS maximum FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber) AS rn
  FROM lineitem) WHERE rn <= 2 GROUP BY l_orderkey""")
def agg_08(spark, d):
    li = table(spark, d, "lineitem")
    out = A.top_n_sum(li, ["l_orderkey"], "l_extendedprice", "l_linenumber", n=2, plus=600.0, out="maximum")
    return out.withColumn("maximum", F.round("maximum", 2))


@register("agg-09", """
SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_split_to_array(p_name, ' '))) AS term FROM part)
WHERE term <> '' GROUP BY term""")
def agg_09(spark, d):
    p = table(spark, d, "part")
    return A.term_counts(p, F.split("p_name", " ")).orderBy(F.col("n").desc(), "term")


@register("agg-10", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) OVER (PARTITION BY year(o_orderdate)) AS n_in_year
FROM orders""")
def agg_10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return A.grouped_by_year(o, "o_orderdate").select("o_orderkey", "year", "n_in_year") \
        .orderBy(F.col("year").desc(), F.col("o_orderkey").desc())


@register("agg-10-nested", """
WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS g, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
                  o_orderstatus FROM orders)
SELECT g AS month, CAST((rn - 1) // 20 AS INTEGER) + 1 AS page, (SELECT count(*) FROM orders o WHERE strftime(o.o_orderdate, '%Y-%m') = g) AS n_in_group,
       string_agg(CAST(o_orderkey AS VARCHAR) || o_orderstatus, ',' ORDER BY rn) AS items, CAST(count(*) AS INTEGER) AS n_items FROM x GROUP BY g, (rn - 1) // 20""")
def agg_10_nested(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    nested = A.nested_by_date(o, "o_orderdate", "o_orderkey", "yyyy-MM", ["o_orderkey", "o_orderstatus"], page=20)
    shown = F.array_join(F.transform("items", lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",")
    return nested.select(F.col("group").alias("month"), "page", "n_in_group", shown.alias("items"), F.size("items").alias("n_items"))


@register("agg-11", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY year DESC")
def agg_11(spark, d):
    return A.distinct_desc(table(spark, d, "orders"), F.year("o_orderdate"), "year")


@register("agg-12", """
SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total,
       (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') > 10 AS more
FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def agg_12(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == "O")
    total = A.total_of(o)
    top = o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(10)
    return top.select("o_orderkey", total.alias("total"), (total > 10).alias("more"))


@register("agg-13", """
SELECT event_type, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0)) AS BIGINT) AS k_sum,
       (SELECT CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0)) AS BIGINT) FROM events) AS k_total
FROM events GROUP BY event_type""")
def agg_13(spark, d):
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    total = ev.select(A.tolerant_sum("k")).scalar()
    return ev.groupBy("event_type").agg(A.tolerant_sum("k").alias("k_sum")).withColumn("k_total", total)


@register("agg-14", """
SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) /
       nullif((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part), 0), 6) AS scaled
FROM part""")
def agg_14(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return A.min_max_scaled(p, "p_retailprice", "scaled").select("p_partkey", F.round("scaled", 6).alias("scaled"))


@register("agg-15", """
SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
       count(*) FILTER (WHERE l_linestatus = 'F') AS n_final FROM lineitem GROUP BY l_orderkey""")
def agg_15(spark, d):
    li = table(spark, d, "lineitem")
    return A.count_labels(li, ["l_orderkey"], {"n_returned": F.col("l_returnflag") == "R",
                                               "n_final": F.col("l_linestatus") == "F"})


@register("agg-16", """
SELECT user_id, event_id AS best_event_id, k AS best_k FROM (
  SELECT user_id, event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) DESC,
                            event_id DESC) AS rn
  FROM events WHERE props IS NOT NULL AND event_type IS NOT NULL) WHERE rn = 1""")
def agg_16(spark, d):
    ev = table(spark, d, "events").where(F.col("props").isNotNull() & F.col("event_type").isNotNull()) \
        .withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return ev.groupBy("user_id").agg(A.best_by("event_id", "k", "event_id").alias("best_event_id"),
                                     A.best_by("k", "k", "event_id").alias("best_k"))


@register("agg-17", """
SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role,
       CAST(length(arg_max(text, turn)) AS INTEGER) AS last_len, arg_max(role, turn) = 'user' AS from_user
FROM conversations GROUP BY conv_id""")
def agg_17(spark, d):
    c = table(spark, d, "conversations")
    last_role = A.best_by("role", "turn")
    return c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), last_role.alias("last_role"),
                                    F.length(A.best_by("text", "turn")).alias("last_len"),
                                    (last_role == "user").alias("from_user"))


@register("agg-18", """
SELECT conv_id, count(*) FILTER (WHERE text <> '') AS n_messages, max(turn) AS last_turn
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE text <> '') > 0
ORDER BY last_turn DESC, conv_id""")
def agg_18(spark, d):
    return A.active_groups(table(spark, d, "conversations"), "conv_id", "text", "turn")


@register("agg-19", """
SELECT o_custkey, CASE WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 0 THEN 'Not yet'
                       ELSE 'Completed' END AS group_completed
FROM orders GROUP BY o_custkey""")
def agg_19(spark, d):
    o = table(spark, d, "orders")
    g = o.groupBy("o_custkey").agg(strict_sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("_t"))
    return g.select("o_custkey", A.status_label(F.col("_t")).alias("group_completed"))


@register("agg-07-null", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT event_id, nullif(user_id, 13) AS user_id FROM events)")
def agg_07_null(spark, d):
    ev = table(spark, d, "events").select("event_id", F.nullif(F.col("user_id"), F.lit(13).cast("bigint")).alias("user_id"))
    return A.group_size(ev, ["user_id"])


@register("agg-10-null", """
SELECT o_orderkey, CAST(year(day) AS INTEGER) AS year, count(*) OVER (PARTITION BY year(day)) AS n_in_year
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS day FROM orders)""")
def agg_10_null(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("day"))
    return A.grouped_by_year(o, "day").select("o_orderkey", "year", "n_in_year")
