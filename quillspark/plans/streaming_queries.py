"""STR-*: streaming replays of the ``events`` table, compared with batch SQL."""

from pyspark.sql import functions as F

from quillspark.plans.registry import register
from quillspark.plans.tables import table
from quillspark.sources.files import new_path
from quillspark.streaming import jobs as S


@register("str-01", """
WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL
                  OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS brk
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events
FROM b GROUP BY user_id, sid""")
def str_01(spark, d):
    return S.run_bursts(spark, d, new_path(spark, "bursts"), new_path(spark, "bursts-ckpt"), S.replay_delay(spark, d), close=True)


GAP_MS = 24 * 60 * 60 * 1000


@register("str-01-sender", f"""
WITH e AS (SELECT event_id, ts, CASE WHEN user_id % 10 = 3 THEN NULL WHEN user_id % 10 = 4 THEN -1 ELSE user_id END AS conv, CASE WHEN event_type <> 'error' THEN event_type END AS sender FROM events),
a AS (SELECT *, CASE WHEN lag(sender) OVER w = sender AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {GAP_MS}000 THEN 0 ELSE 1 END AS brk
      FROM e WINDOW w AS (PARTITION BY conv ORDER BY ts, event_id)),
b AS (SELECT *, sum(brk) OVER (PARTITION BY conv ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM a)
SELECT conv, sender, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS n_events FROM b GROUP BY conv, sender, run""")
def str_01_sender(spark, d):
    """Users stand for conversations (a tenth of them null, a tenth -1), event types for senders (one of them missing); the
    events are written in several files by time, and read a few at a time."""
    u, t = F.col("user_id"), F.col("event_type")
    ev = table(spark, d, "events").withColumns({"user_id": F.when(u % 10 == 3, None).when(u % 10 == 4, F.lit(-1).cast("long")).otherwise(u), "event_type": F.when(t != "error", t)})
    folder = new_path(spark, "sender-events")
    ev.repartitionByRange(4, "ts").write.parquet(folder)
    out = S.run_sender_bursts(spark, folder, new_path(spark, "sender"), new_path(spark, "sender-ckpt"), S.replay_delay(spark, folder, "*.parquet"),
                              "user_id", "event_type", GAP_MS, "*.parquet", max_files=2, close=True)
    return out.withColumnRenamed("user_id", "conv")


@register("str-02", """
SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def str_02(spark, d):
    delay = S.replay_delay(spark, d)
    windows = S.run_folder(spark, d, lambda e: S.attempts_by_window(e, "user_id", delay), new_path(spark, "first"), new_path(spark, "first-ckpt"), close=True)
    return S.first_of_windows(windows, "user_id").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("str-02-again", """
SELECT user_id, arg_min(event_id, {'ts': ts, 'id': event_id}) AS event_id, count(*) AS n_attempts FROM events GROUP BY user_id""")
def str_02_again(spark, d):
    """A third of the events is delivered again in a later file: each counts once. The files are as many for any number of
    events, as every micro-batch goes through the state."""
    ev, folder = table(spark, d, "events"), new_path(spark, "again-events")
    for delivered in (ev, ev.where("event_id % 3 = 0")):
        delivered.repartitionByRange(4, "ts").write.mode("append").parquet(folder)
    delay = S.replay_delay(spark, folder, "*.parquet")
    windows = S.run_folder(spark, folder, lambda e: S.attempts_by_window(e, "user_id", delay), new_path(spark, "again"), new_path(spark, "again-ckpt"),
                           "*.parquet", max_files=1, close=True)
    return S.first_of_windows(windows, "user_id").select("user_id", "event_id", "n_attempts")


@register("str-03", """
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(event_type || ' ' || props, '[^a-z0-9]+')) AS term FROM events)
WHERE term <> '' GROUP BY term""")
def str_03(spark, d):
    terms = F.filter(F.split(F.concat_ws(" ", "event_type", "props"), "[^a-z0-9]+"), lambda t: t != "")
    counts = S.term_counts(S.event_stream(spark, d), terms)
    return S.run_updates(counts, ["term"], new_path(spark, "terms"), new_path(spark, "terms-ckpt"))
