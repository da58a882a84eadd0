"""WIN-*: window functions."""

from pyspark.sql import functions as F

from quillspark.operators import windows as W
from quillspark.plans.registry import register
from quillspark.plans.tables import table

BLANK_ID = "CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END"


def _events_with_id(spark, d):
    ev = table(spark, d, "events")
    return ev.withColumn("pid", F.when(F.col("event_type") == "error", F.lit("")).otherwise(
        F.col("user_id").cast("string")))


@register("win-01", f"""
SELECT event_id, CASE WHEN pid = '' THEN 1 ELSE row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) END AS attempt
FROM (SELECT *, {BLANK_ID} AS pid FROM events)""")
def win_01(spark, d):
    ev = _events_with_id(spark, d).select("event_id", "pid", "ts")
    return W.attempts(ev, "pid", [F.col("ts").asc(), F.col("event_id").asc()]).select("event_id", "attempt")


@register("win-02", f"""
SELECT event_id, CASE WHEN pid <> '' AND row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) > 1
                      THEN 'True' ELSE 'False' END AS duplicate
FROM (SELECT *, {BLANK_ID} AS pid FROM events)""")
def win_02(spark, d):
    ev = _events_with_id(spark, d).select("event_id", "pid", "ts")
    a = W.attempts(ev, "pid", [F.col("ts").asc(), F.col("event_id").asc()])
    return a.select("event_id", W.duplicate_flag(F.col("attempt"), "pid").alias("duplicate"))


@register("win-03", """
SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def win_03(spark, d):
    li = table(spark, d, "lineitem")
    return W.first_per_group(li, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")]) \
        .select("l_orderkey", "l_linenumber")


@register("win-04", """
SELECT l_orderkey, l_linenumber, count(*) OVER w AS n,
       string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) OVER w AS flags_concat,
       CASE WHEN count(*) OVER w = 2 AND min(coalesce(l_returnflag, 'NA')) OVER w = max(coalesce(l_returnflag, 'NA')) OVER w THEN 1 ELSE 0 END AS dup_equal
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_04(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return W.duplicate_report(li, ["l_orderkey"], "l_returnflag", ["l_linenumber"]) \
        .select("l_orderkey", "l_linenumber", "n", "flags_concat", "dup_equal")


@register("win-04-groups", """
SELECT l_suppkey, count(*) AS n, string_agg(coalesce(l_returnflag, 'NA'), '' ORDER BY l_orderkey, l_linenumber, l_returnflag) AS flags_concat,
       CASE WHEN count(*) = 2 AND min(coalesce(l_returnflag, 'NA')) = max(coalesce(l_returnflag, 'NA')) THEN 1 ELSE 0 END AS dup_equal
FROM lineitem GROUP BY l_suppkey""")
def win_04_groups(spark, d):
    """The report with each group's text once: suppliers are large groups."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return W.duplicate_groups(li, ["l_suppkey"], "l_returnflag", ["l_orderkey", "l_linenumber"])


@register("win-05", """
WITH a AS (SELECT event_id, user_id, ts,
             coalesce(event_type = lag(event_type) OVER w AND
                      (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000 <= 86400000, false) AS link
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(lead(link) OVER w, false) AS next_link,
             CAST(sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS burst_id
      FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, burst_id, link OR next_link AS in_burst, next_link AND NOT link AS is_first,
       link AND NOT next_link AS is_last FROM b""")
def win_05(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")   # users stand for conversations, types for senders
    b = W.bursts(ev, "user_id", "event_type", "ts", "event_id", gap_ms=24 * 60 * 60 * 1000)
    return b.select("event_id", "burst_id", "in_burst", "is_first", "is_last")


@register("win-06", """
SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return W.neighbours(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "prev", "next")


@register("win-07", """
SELECT o_orderkey, CAST(ceil(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) / 10) AS BIGINT) AS page,
       ceil(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) / 10) > 1 AS has_prev,
       ceil(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) / 10) < ceil((SELECT count(*) FROM orders) / 10) AS has_next
FROM orders""")
def win_07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return W.paginate(o, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]) \
        .select("o_orderkey", "page", "has_prev", "has_next")


@register("win-08", """
SELECT l_orderkey, l_linenumber, row_number() OVER w = 1 AS is_first,
       row_number() OVER w < count(*) OVER (PARTITION BY l_orderkey) AS not_last
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def win_08(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return W.positions(li, ["l_orderkey"], ["l_linenumber"], skew_safe=True).select("l_orderkey", "l_linenumber", "is_first", "not_last")


@register("win-09", """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) % 2 = 1 AS is_odd FROM part""")
def win_09(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    # brands are not bounded by the data model: numbering is skew-safe
    return W.positions(p, ["p_brand"], ["p_partkey"], skew_safe=True).select("p_partkey", "is_odd")


@register("win-10", """
SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS duration_s
FROM events""")
def win_10(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts")
    return W.stage_durations(ev, "user_id", "ts", "event_id").select("event_id", "duration_s")


# ---- the same operators where the key is missing for some rows --------------------
NULL_ID = "nullif(CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END, '13')"
NULL_USER = "(SELECT event_id, nullif(user_id, 13) AS user_id, ts FROM events)"


def _null_user(spark, d):
    return table(spark, d, "events").select("event_id", F.nullif(F.col("user_id"), F.lit(13).cast("bigint")).alias("user_id"), "ts")


@register("win-01-null", f"""
SELECT event_id, CASE WHEN pid = '' THEN 1 ELSE row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) END AS attempt
FROM (SELECT *, {NULL_ID} AS pid FROM events)""")
def win_01_null(spark, d):
    ev = _events_with_id(spark, d).select("event_id", F.nullif(F.col("pid"), F.lit("13")).alias("pid"), "ts")
    return W.attempts(ev, "pid", [F.col("ts").asc(), F.col("event_id").asc()]).select("event_id", "attempt")


@register("win-05-null", f"""
WITH e AS {NULL_USER}, a AS (SELECT event_id, user_id, ts,
             coalesce(user_id = lag(user_id) OVER w AND
                      (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000 <= 1800000, false) AS link
           FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(lead(link) OVER w, false) AS next_link,
             CAST(sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS burst_id
      FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, burst_id, link OR next_link AS in_burst, next_link AND NOT link AS is_first,
       link AND NOT next_link AS is_last FROM b""")
def win_05_null(spark, d):
    b = W.bursts(_null_user(spark, d), "user_id", "user_id", "ts", "event_id", gap_ms=30 * 60 * 1000)
    return b.select("event_id", "burst_id", "in_burst", "is_first", "is_last")


@register("win-06-null", """
SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next
FROM (SELECT *, nullif(o_orderstatus, 'F') AS section FROM orders) WINDOW w AS (PARTITION BY section ORDER BY o_orderdate, o_orderkey)""")
def win_06_null(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("section"), "o_orderdate")
    return W.neighbours(o, "section", ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "prev", "next")


@register("win-10-null", f"""
SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS duration_s
FROM {NULL_USER}""")
def win_10_null(spark, d):
    return W.stage_durations(_null_user(spark, d), "user_id", "ts", "event_id").select("event_id", "duration_s")
