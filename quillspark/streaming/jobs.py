"""Structured Streaming jobs (STR-01..03) on the same semantics as the
batch operators: live bursts (session windows), bursts of one sender in a
conversation, first attempt per id and incremental term counts.

Output and checkpoint folders are parameters: a query started again with the
same two goes on where it stopped, after a driver restart or a lost executor.
Append output goes to a file sink; update output writes each micro-batch to a
folder of its own number, so a batch that is run again replaces only itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: The state of sender bursts is kept in RocksDB, and each micro-batch writes what it changed.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
               "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}
SENTINEL_TS = dt.datetime(2200, 1, 1)   # within the range of nanosecond timestamps, which Python operators use


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet",
                 schema: str = EVENTS_SCHEMA, max_files: int | None = None) -> DataFrame:
    """A file stream of event rows (explicit schema; event time as timestamp)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def replay_delay(spark: SparkSession, folder: str, pattern: str = "events.parquet", schema: str = EVENTS_SCHEMA) -> str:
    """A watermark delay under which no event of a finite folder is late: files are taken in order of modification, so it
    is the longest time that a file goes back behind the events of earlier ones (files of one time come in any order)."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    times = (spark.read.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
             .select(t.alias("t"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"))
             .groupBy("at").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.countDistinct("path").alias("files")))
    before = F.max("hi").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    back = F.greatest(before - F.col("lo"), F.when(F.col("files") > 1, F.col("hi") - F.col("lo")), F.lit(0))
    r = times.select(back.alias("back")).agg(F.max("back").alias("s")).first()
    return f"{(r['s'] or 0) + 1} seconds"


def live_bursts(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes",
                delay: str = "30 minutes") -> DataFrame:
    """STR-01: activity sessions per key; events at most ``gap`` apart
    (inclusive) share a session. Emitted once the watermark passes."""
    s = (events.withWatermark(ts, delay)
               .groupBy(key, F.session_window(ts, gap).alias("s"))
               .agg(F.count(F.lit(1)).alias("n_events")))
    return s.select(key, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_events")


class SenderBursts:
    """State of a bucket of conversations: events that the watermark has not passed (bounded by the delay), and the open burst
    of each conversation, packed as columns, so that the conversations of a bucket are dealt with at once. Events are taken in
    order of time once the watermark has passed them; a burst closes when another sender speaks, or when the watermark is so
    far on that no event can follow within the gap. The timeout is set to the next of these moments only. A bucket's state is
    one value, of 2 GB at most (some 70 million waiting events)."""

    STATE = "pending binary, open binary, names string"
    EVENT = [("none", "<i1"), ("conv", "<i8"), ("start", "<i8"), ("tie", "<i8"), ("sender", "<i4")]
    BURST = [("none", "<i1"), ("conv", "<i8"), ("start", "<i8"), ("last", "<i8"), ("sender", "<i4"), ("n", "<i8")]

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def __call__(self, key, parts, state):
        import json

        import numpy as np
        passed = state.getCurrentWatermarkMs() * 1000
        pending, opened, names = (state.get if state.exists else (b"", b"", "[]"))
        pending, opened, names = [np.frombuffer(pending, self.EVENT)], np.frombuffer(opened, self.BURST), json.loads(names)
        for part in parts:
            pending.append(self.packed(part[~part["end"].astype(bool)], names))
        pending = np.concatenate(pending)
        ready = pending["start"] <= passed
        bursts = self.runs(opened, pending[ready])
        pending = pending[~ready]
        ends = bursts["last"] + self.gap
        # the last burst of a conversation stays open until no event can follow within the gap
        is_open = np.ones(len(bursts), bool)
        is_open[:-1] = (bursts["conv"][1:] != bursts["conv"][:-1]) | (bursts["none"][1:] != bursts["none"][:-1])
        is_open &= ends > passed
        closed, opened = bursts[~is_open], bursts[is_open]
        waits = [int(x.min()) for x in (pending["start"], ends[is_open]) if len(x)]
        if len(closed):
            yield self.shown(closed, names)
        if waits:
            used = np.unique(np.concatenate([pending["sender"], opened["sender"]]))
            used = used[used >= 0]
            for x in (pending, opened):   # names that nobody has any more are dropped
                x["sender"] = np.where(x["sender"] < 0, -1, np.searchsorted(used, x["sender"]))
            state.update((pending.tobytes(), opened.tobytes(), json.dumps([names[i] for i in used])))
            state.setTimeoutTimestamp(-(-min(waits) // 1000))
        elif state.exists:
            state.remove()

    def packed(self, rows, names: list):
        """Rows as events; senders by their place in ``names``, which grows by new ones. A missing sender is -1."""
        import numpy as np
        import pandas as pd
        out = np.empty(len(rows), self.EVENT)
        for name, column in (("none", "none"), ("conv", "conv"), ("start", "us"), ("tie", "tie")):
            out[name] = rows[column].astype("int64")
        codes, found = pd.factorize(rows["sender"])
        known = {x: i for i, x in enumerate(names)}
        names += [x for x in found if x not in known]
        known = {x: i for i, x in enumerate(names)}
        out["sender"] = np.array([known[x] for x in found] + [-1])[codes]
        return out

    def runs(self, opened, events):
        """Open bursts and the events after them, put together to bursts in order of conversation and time."""
        import numpy as np
        rows = np.empty(len(opened) + len(events), [*self.BURST, ("tie", "<i8"), ("later", "?")])
        for name in ("none", "conv", "start", "sender"):
            rows[name] = np.concatenate([opened[name], events[name]])
        rows["last"], rows["n"] = np.concatenate([opened["last"], events["start"]]), np.concatenate([opened["n"], np.ones(len(events), "<i8")])
        rows["tie"], rows["later"] = np.concatenate([np.zeros(len(opened), "<i8"), events["tie"]]), np.arange(len(rows)) >= len(opened)
        rows = rows[np.lexsort((rows["tie"], rows["start"], rows["later"], rows["conv"], rows["none"]))]
        before, after = rows[:-1], rows[1:]
        first = np.ones(len(rows), bool)
        first[1:] = ((after["none"] != before["none"]) | (after["conv"] != before["conv"]) | (after["sender"] < 0)
                     | (after["sender"] != before["sender"]) | (after["start"] - before["last"] > self.gap))
        at = np.flatnonzero(first)
        out = np.empty(len(at), self.BURST)
        if len(at):
            for name in ("none", "conv", "start", "sender"):
                out[name] = rows[name][at]
            out["last"], out["n"] = rows["last"][np.append(at[1:], len(rows)) - 1], np.add.reduceat(rows["n"], at)
        return out

    def shown(self, bursts, names: list):
        import numpy as np
        import pandas as pd
        sender = np.array([*names, None], object)[bursts["sender"]]
        return pd.DataFrame({"none": bursts["none"].astype("int32"), "conv": bursts["conv"], "sender": sender, "start": bursts["start"],
                             "end": bursts["last"], "n_events": bursts["n"]})


def sender_bursts(events: DataFrame, conv: str, sender: str, gap_ms: int, delay: str, ts: str = "ts", tie: str = "event_id", buckets: int = 512) -> DataFrame:
    """STR-01 with senders: runs of one sender's messages in a conversation (a long, null included), each at most ``gap_ms`` after
    the one before (inclusive), as in WIN-05; a missing sender never continues a burst. Emitted once they are closed. Conversations are dealt into
    ``buckets`` of one state each; a checkpoint goes on with the number that it began with."""
    rows = events.withWatermark(ts, delay).select(
        F.when(F.col("_end"), 2).when(F.col(conv).isNull(), 1).otherwise(0).alias("none"), F.coalesce(F.col(conv).cast("long"), F.lit(0)).alias("conv"),
        F.unix_micros(ts).alias("us"), F.col(tie).alias("tie"), F.col(sender).alias("sender"), F.col("_end").alias("end"), ts)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("none", "conv"), F.lit(buckets)).cast("int"))
    closing = SenderBursts(gap_ms)
    found = rows.groupBy("bucket").applyInPandasWithState(
        lambda key, parts, state: closing(key, parts, state), "none int, conv long, sender string, start long, end long, n_events long",
        SenderBursts.STATE, "append", "EventTimeTimeout")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select(F.when(F.col("none") == 0, F.col("conv")).alias(conv), "sender", at("start").alias("burst_start"), at("end").alias("burst_end"), "n_events")


def attempts_by_window(events: DataFrame, key: str, delay: str, window: str = "1 day", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """STR-02, streaming part: of each ``window`` of time and key the earliest attempt (by time, then ``tie``) and the number of
    attempts. Events that arrive again (the same ``tie``, within the watermark's delay) count once. The state holds the ids
    of the delay and the keys of open windows, and is dropped as the watermark passes them. Finish with ``first_of_windows``."""
    once = events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([tie])
    first = F.min(F.struct(F.col(ts).alias(ts), F.col(tie).alias(tie))).alias("first")
    return once.groupBy(key, F.window(ts, window).alias("w")).agg(first, F.count(F.lit(1)).alias("n")).select(key, f"first.{ts}", f"first.{tie}", "n")


def first_of_windows(windows: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """STR-02: the earliest attempt of each key over all windows written so far, and its number of attempts."""
    first = F.min(F.struct(F.col(ts).alias(ts), F.col(tie).alias(tie))).alias("_first")
    return windows.groupBy(key).agg(first, F.sum("n").alias("n_attempts")).select(key, f"_first.{ts}", f"_first.{tie}", "n_attempts")


def first_attempts(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """STR-02 as running updates: the earliest row per key so far, by time and then ``tie``, known at once but with a state
    of one row per key. Run with ``run_updates``."""
    first = F.min(F.struct(F.col(ts).alias(ts), F.col(tie).alias(tie))).alias("_first")
    return events.groupBy(key).agg(first).select(key, F.col(f"_first.{ts}").alias(ts), F.col(f"_first.{tie}").alias(tie))


def term_counts(events: DataFrame, terms: Column, out: str = "term") -> DataFrame:
    """STR-03: running count per term of an array column (state is one row per term). Run with ``run_updates``."""
    return events.select(F.explode(terms).alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("n"))


def _finish(query) -> None:
    query.awaitTermination()


def run_append(df: DataFrame, out: str, checkpoint: str, progress: list | None = None) -> DataFrame:
    """Run a stream over what is available now into a Parquet file sink
    (exactly-once) and return the written table; call it again with the same
    folders to take in what came since. ``progress`` receives the micro-batches' reports."""
    query = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    _finish(query)
    if progress is not None:
        progress += query.recentProgress
    return df.sparkSession.read.schema(df.schema).parquet(out)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """``STATE_STORE`` while streams are started and run; a checkpoint goes on with the store that it began with."""
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_folder(spark: SparkSession, folder: str, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
               pattern: str = "events.parquet", max_files: int | None = None, close: bool = False, progress: list | None = None) -> DataFrame:
    """Run an append ``job`` over a folder of event files, in as many micro-batches as it takes. What the watermark has not
    passed stays open in the state until later files pass it; ``close`` ends the stream for good: one event far in the
    future (marked by ``_end``), which joins the same stream with the last of the others or after them, lets it out and stays
    open itself."""
    ends = f"{out}-ends"
    spark.createDataFrame([], EVENTS_SCHEMA).write.mode("append").parquet(ends)   # the folder must exist

    def run() -> DataFrame:
        events = event_stream(spark, folder, pattern, max_files=max_files).withColumn("_end", F.lit(False))
        return run_append(job(events.unionByName(event_stream(spark, ends, "*.parquet").withColumn("_end", F.lit(True)))), out, checkpoint, progress)
    # without a bound on files all that is there is one batch, which the closing event may join; else it must come after all others
    out_table = run() if max_files or not close else None
    if close:
        spark.createDataFrame([(-1, SENTINEL_TS, None, "__end__", None, None)], EVENTS_SCHEMA).write.mode("append").parquet(ends)
        out_table = run()
    return out_table


def run_bursts(spark: SparkSession, folder: str, out: str, checkpoint: str, delay: str, pattern: str = "events.parquet",
               max_files: int | None = None, close: bool = False, **kw) -> DataFrame:
    """STR-01 over a folder of event files (see ``run_folder``)."""
    return run_folder(spark, folder, lambda events: live_bursts(events, delay=delay, **kw), out, checkpoint, pattern, max_files, close)


def run_sender_bursts(spark: SparkSession, folder: str, out: str, checkpoint: str, delay: str, conv: str, sender: str, gap_ms: int,
                      pattern: str = "events.parquet", max_files: int | None = None, close: bool = False, progress: list | None = None) -> DataFrame:
    """``sender_bursts`` over a folder of event files (see ``run_folder``)."""
    with state_store(spark):
        return run_folder(spark, folder, lambda events: sender_bursts(events, conv, sender, gap_ms, delay), out, checkpoint, pattern, max_files, close, progress)


def run_updates(df: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Run an aggregation in update mode over what is available now; each
    micro-batch writes the groups that changed to its own folder, and the
    result is each group's latest row."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _finish(df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    values = [c for c in df.columns if c not in keys]
    changed = df.sparkSession.read.schema(df.schema.add("batch", "long")).parquet(out)
    latest = changed.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])
