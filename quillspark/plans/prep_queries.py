"""E2: the preparation flow on ``events`` (user = participant, event type =
page, ``props.k`` = packed code), checked against one SQL statement."""

from pyspark.sql import functions as F

from quillspark.operators.joins import join_back
from quillspark.operators.prep import Milestones, group_counts, prepare
from quillspark.plans.registry import register
from quillspark.plans.tables import table

MILESTONES = Milestones(
    pages=["signup", "view", "click", "purchase"],
    stages={"time_view": ("signup", "view"), "time_click": ("view", "click"),
            "time_purchase": ("click", "purchase"), "time_total": ("signup", "purchase")})


def participants(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy("user_id").agg(
        F.floor(F.col("user_id") / 4).alias("group_id"),
        F.concat(F.lit("P"), F.floor(F.col("user_id") / 2).cast("string")).alias("pid_code"),
        F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("payoff1"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("payoff2"),
        F.max(F.get_json_object("props", "$.k")).alias("edu"),
        F.count(F.lit(1)).alias("n_events"))


def _us(c):
    return f"epoch_us({c})"


@register("e2-prep", f"""
WITH p AS (SELECT user_id, CAST(floor(user_id / 4) AS BIGINT) AS group_id, 'P' || CAST(floor(user_id / 2) AS BIGINT) AS pid_code,
                  sum(value) FILTER (WHERE event_type = 'click') AS payoff1,
                  sum(value) FILTER (WHERE event_type = 'purchase') AS payoff2,
                  max(json_extract_string(props, '$.k')) AS edu, count(*) AS n_events
           FROM events GROUP BY user_id),
t AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS page_signup,
             min(ts) FILTER (WHERE event_type = 'view') AS page_view,
             min(ts) FILTER (WHERE event_type = 'click') AS page_click,
             min(ts) FILTER (WHERE event_type = 'purchase') AS page_purchase FROM events GROUP BY user_id),
j AS (SELECT p.*, t.page_signup AS date,
             ({_us('t.page_view')} - {_us('t.page_signup')}) / 1e6 AS time_view,
             ({_us('t.page_click')} - {_us('t.page_view')}) / 1e6 AS time_click,
             ({_us('t.page_purchase')} - {_us('t.page_click')}) / 1e6 AS time_purchase,
             ({_us('t.page_purchase')} - {_us('t.page_signup')}) / 1e6 AS time_total
      FROM p LEFT JOIN t USING (user_id)),
g AS (SELECT *, CASE WHEN count(payoff1) OVER w = count(*) OVER w THEN sum(payoff1) OVER w END AS group_payoff1,
             CASE WHEN count(payoff2) OVER w = count(*) OVER w THEN sum(payoff2) OVER w END AS group_payoff2
      FROM j WINDOW w AS (PARTITION BY group_id)),
mx AS (SELECT group_id, CASE WHEN count(payoff1) = count(*) THEN sum(payoff1) END + 600.0 AS maximum1 FROM (
         SELECT group_id, payoff1, row_number() OVER (PARTITION BY group_id ORDER BY payoff1 DESC NULLS LAST, user_id) AS rn
         FROM j) WHERE rn <= 2 GROUP BY group_id),
a AS (SELECT g.*, mx.maximum1,
             CASE WHEN pid_code = '' THEN 1 ELSE row_number() OVER (PARTITION BY pid_code ORDER BY date NULLS LAST, user_id) END AS attempt
      FROM g LEFT JOIN mx USING (group_id)),
v AS (SELECT *, CASE WHEN attempt > 1 THEN 'duplicate' WHEN pid_code = '' THEN 'auto_advanced'
                     WHEN time_view > 82800 THEN 'auto_advanced' WHEN time_click > 82800 THEN 'auto_advanced'
                     WHEN time_purchase > 82800 THEN 'auto_advanced' ELSE '' END AS invalid FROM a),
k AS (SELECT * FROM v WHERE group_id IN (SELECT group_id FROM v WHERE invalid = '') AND time_total IS NOT NULL)
SELECT user_id, group_id, attempt, invalid, CASE WHEN invalid = '' THEN 'yes' ELSE '' END AS valid, date,
       time_view, time_click, time_purchase, time_total, n_events, round(group_payoff1, 2) AS group_payoff1,
       round(group_payoff2, 2) AS group_payoff2, round(maximum1, 2) AS maximum1,
       CASE WHEN group_payoff1 = 0 THEN 'Not yet' ELSE 'Completed' END AS group_completed,
       CASE WHEN NOT coalesce(time_total < 30, false) AND NOT coalesce(invalid <> '', false) THEN edu END AS edu,
       CASE WHEN NOT coalesce(time_total < 30, false) AND NOT coalesce(invalid <> '', false) THEN round(payoff2, 2) END AS payoff2
FROM k""")
def e2_prep(spark, d):
    ev = table(spark, d, "events")
    out = prepare(participants(spark, d), ev, pid="user_id", page="event_type", ts="ts", id_col="pid_code",
                  group="group_id", m=MILESTONES, payoffs=["payoff1", "payoff2"], human=["edu", "payoff2"],
                  private=["pid_code", "payoff1"])
    return out.select("user_id", "group_id", "attempt", "invalid", "valid", "date", "time_view", "time_click",
                      "time_purchase", "time_total", "n_events", F.round("group_payoff1", 2).alias("group_payoff1"),
                      F.round("group_payoff2", 2).alias("group_payoff2"), F.round("maximum1", 2).alias("maximum1"),
                      "group_completed", "edu", F.round("payoff2", 2).alias("payoff2"))


@register("e2-prep-full", f"""
WITH p AS (SELECT user_id, CAST(floor(user_id / 4) AS BIGINT) AS group_id, 'P' || CAST(floor(user_id / 2) AS BIGINT) AS pid_code,
                  sum(value) FILTER (WHERE event_type = 'click') AS payoff1,
                  sum(value) FILTER (WHERE event_type = 'purchase') AS payoff2,
                  max(json_extract_string(props, '$.k')) AS edu, count(*) AS n_events
           FROM events GROUP BY user_id),
t AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS page_signup,
             min(ts) FILTER (WHERE event_type = 'view') AS page_view,
             min(ts) FILTER (WHERE event_type = 'click') AS page_click,
             min(ts) FILTER (WHERE event_type = 'purchase') AS page_purchase FROM events GROUP BY user_id),
j AS (SELECT p.*, t.page_signup AS date,
             ({_us('t.page_view')} - {_us('t.page_signup')}) / 1e6 AS time_view,
             ({_us('t.page_click')} - {_us('t.page_view')}) / 1e6 AS time_click,
             ({_us('t.page_purchase')} - {_us('t.page_click')}) / 1e6 AS time_purchase,
             ({_us('t.page_purchase')} - {_us('t.page_signup')}) / 1e6 AS time_total
      FROM p LEFT JOIN t USING (user_id)),
g AS (SELECT *, CASE WHEN count(payoff1) OVER w = count(*) OVER w THEN sum(payoff1) OVER w END AS group_payoff1,
             CASE WHEN count(payoff2) OVER w = count(*) OVER w THEN sum(payoff2) OVER w END AS group_payoff2
      FROM j WINDOW w AS (PARTITION BY group_id)),
mx AS (SELECT group_id, CASE WHEN count(payoff1) = count(*) THEN sum(payoff1) END + 600.0 AS maximum1 FROM (
         SELECT group_id, payoff1, row_number() OVER (PARTITION BY group_id ORDER BY payoff1 DESC NULLS LAST, user_id) AS rn
         FROM j) WHERE rn <= 2 GROUP BY group_id),
mx2 AS (SELECT group_id, CASE WHEN count(payoff2) = count(*) THEN sum(payoff2) END + 600.0 AS maximum2 FROM (
         SELECT group_id, payoff2, row_number() OVER (PARTITION BY group_id ORDER BY payoff2 DESC NULLS LAST, user_id) AS rn
         FROM j) WHERE rn <= 2 GROUP BY group_id),
a AS (SELECT g.*, mx.maximum1, mx2.maximum2,
             CASE WHEN pid_code = '' THEN 1 ELSE row_number() OVER (PARTITION BY pid_code ORDER BY date NULLS LAST, user_id) END AS attempt
      FROM g LEFT JOIN mx USING (group_id) LEFT JOIN mx2 USING (group_id)),
v AS (SELECT *, CASE WHEN user_id IN (SELECT s_suppkey FROM supplier) AND user_id % 3 = 0 OR attempt > 1 THEN 'duplicate' WHEN pid_code = '' THEN 'auto_advanced'
                     WHEN time_view > 82800 THEN 'auto_advanced' WHEN time_click > 82800 THEN 'auto_advanced'
                     WHEN time_purchase > 82800 THEN 'auto_advanced' ELSE '' END AS invalid FROM a),
k AS (SELECT * FROM v WHERE group_id IN (SELECT group_id FROM v WHERE invalid = '') AND time_total IS NOT NULL)
SELECT group_id, user_id, attempt, invalid, round(maximum1, 2) AS maximum1, round(maximum2, 2) AS maximum2,
       count(*) OVER (PARTITION BY group_id) AS n_members,
       CAST(count(*) FILTER (WHERE (CASE WHEN group_payoff1 = 0 THEN 'Not yet' ELSE 'Completed' END) = 'Completed') OVER (PARTITION BY group_id) AS BIGINT) AS n_completed
FROM k""")
def e2_prep_full(spark, d):
    """Both rounds' maxima, an exclusions table and the groups' counts; the group first."""
    ev = table(spark, d, "events")
    listed = table(spark, d, "supplier").select("s_suppkey").where(F.col("s_suppkey") % 3 == 0)
    out = prepare(participants(spark, d), ev, pid="user_id", page="event_type", ts="ts", id_col="pid_code",
                  group="group_id", m=MILESTONES, payoffs=["payoff1", "payoff2"], human=["edu", "payoff2"],
                  private=["pid_code", "payoff1"], exclusions=listed)
    out = join_back(out, group_counts(out, "group_id"), ["group_id"])
    return out.select("group_id", "user_id", "attempt", "invalid", F.round("maximum1", 2).alias("maximum1"),
                      F.round("maximum2", 2).alias("maximum2"), "n_members", "n_completed")
