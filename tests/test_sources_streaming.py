"""Sources read from real files in a scratch folder, and streaming replays
compared with the batch operators."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.windows import bursts
from quillspark.plans.tables import table
from quillspark.sources import archive as AR
from quillspark.sources import files as FS
from quillspark.sources import frontmatter as FM
from quillspark.streaming import jobs as S


def test_front_matter_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: One\ndate: 2022-7-7\ntags: [x, y]\ndraft: true\n---\nBody A\n")
    (tmp_path / "b.md").write_text('+++\ntitle = "Two"\nlang = "nl"\n+++\nBody B')
    (tmp_path / "c.md").write_text("no header at all")
    rows = {os.path.basename(r["doc_key"]): r for r in FM.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.md"]["title"] == "One" and rows["a.md"]["tags"] == ["x", "y"] and rows["a.md"]["draft"] is True
    assert rows["b.md"]["lang"] == "nl" and rows["b.md"]["body"] == "Body B" and rows["b.md"]["format"] == "toml"
    assert rows["c.md"]["format"] == "none" and rows["c.md"]["body"] == "no header at all"


def test_csv_has_header(spark, small_dir):
    path = FS.new_path(spark, "csv-test")
    FS.write_csv(table(spark, small_dir, "region"), path)
    first = spark.read.text(path).where(F.col("value").startswith("r_")).count()
    assert first >= 1


def test_manifest_reports_missing_file(spark, small_dir):
    parts = FS.new_path(spark, "parts")
    catalog = AR.write_parts(table(spark, small_dir, "events"), parts, "event", "event",
                             F.floor(F.col("event_id") / 100), "event_id")
    mpath = FS.new_path(spark, "man")
    AR.write_manifest(catalog, mpath)
    man = AR.read_manifest(spark, mpath)
    extra = spark.createDataFrame([("event", "gone.js", "YTD.event.part999", 5)],
                                  "data_type string, fileName string, globalName string, declared bigint")
    chk = AR.check_manifest(man.unionByName(extra), AR.part_counts(spark, parts))
    bad = [r["globalName"] for r in chk.where(~F.col("ok")).collect()]
    assert bad == ["YTD.event.part999"]


def test_one_part_is_read_by_many_tasks(spark):
    """One file of many records, some with nested lists and what looks like a border, is read in splits without loss."""
    rows = [(i, 'x,  {"event":{' + "y" * (i % 50) + "\n  ]", [(i, "],\n  {"), (i + 1, "}")]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, text string, parts array<struct<n: long, t: string>>")
    path = FS.new_path(spark, "one-part")
    catalog = AR.write_parts(df, path, "event", "event", F.lit(0), "id")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        got = AR.read_parts(spark, path, "event", "struct<id: bigint, text: string, parts: array<struct<n: bigint, t: string>>>")
        assert got.rdd.getNumPartitions() > 5 and len(got.inputFiles()) == 1
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
        assert [tuple(r) for r in AR.part_counts(spark, path).collect()] == [("YTD.event.part0", 20_000, "_part=0")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["count"], r["written"]) for r in catalog.collect()] == [(20_000, 20_000)]


def test_pretty_printed_parts_and_manifest(spark, tmp_path):
    """The layout of real archives: records over several lines, one manifest document, an empty part and one of one record."""
    import json
    records = [{"tweet": {"id": str(i), "media": [{"u": "a\n  },\n  {"}, {"u": str(i)}]}} for i in range(7)]
    folder = tmp_path / "data"
    folder.mkdir()
    pretty = lambda rs: json.dumps(rs, indent=2).replace('": ', '" : ') if rs else "[ ]"
    for k, rs in enumerate((records[:4], records[4:], [])):
        (folder / f"tweets-part{k}.js").write_text(f"window.YTD.tweets.part{k} = {pretty(rs)}")
    (folder / "account.js").write_text(f'window.YTD.account_info.part0 = {pretty([{"tweet": {"id": "me"}}])}\n')
    files = lambda *fs: {"files": [{"fileName": f, "globalName": g, "count": n} for f, g, n in fs]}
    doc = {"userInfo": {"a": "b"}, "dataTypes": {"tweets": {"mediaDirectory": "x", **files(*[(f"data/tweets-part{k}.js", f"YTD.tweets.part{k}", n) for k, n in enumerate(("4", "3", "0"))])},
                                               "accountInfo": files(("data/account.js", "YTD.account_info.part0", "1")), "none": files(("data/n.js", "YTD.none.part0", "?"))}}
    (tmp_path / "manifest.js").write_text("window.__CONFIG = " + json.dumps(doc, indent=2))
    got = AR.read_parts(spark, f"{folder}/tweets-part*.js", "tweet", "struct<id: string, media: array<struct<u: string>>>")
    assert sorted((r["id"], [m["u"] for m in r["media"]]) for r in got.collect()) == [(str(i), ["a\n  },\n  {", str(i)]) for i in range(7)]
    man = AR.read_manifest(spark, str(tmp_path / "manifest.js"))
    checked = AR.check_manifest(man, AR.part_counts(spark, str(folder)))
    rows = {r["globalName"]: tuple(r)[1:] for r in checked.collect()}
    assert rows["YTD.tweets.part1"] == ("tweets", "data/tweets-part1.js", 3, 3, True) and rows["YTD.tweets.part2"][2:] == (0, 0, True)
    assert rows["YTD.none.part0"] == ("none", "data/n.js", 0, None, False)
    kinds = {r["data_type"]: (r["files"], r["entries"], r["ok"], r["single"]) for r in AR.type_assertions(checked).collect()}
    assert kinds == {"tweets": (3, 7, True, False), "accountInfo": (1, 1, True, True), "none": (1, 0, False, False)}
    assert [r["id"] for r in AR.single_entry(AR.read_parts(spark, str(folder / "account.js"), "tweet", "struct<id: string>"), man, "accountInfo").collect()] == ["me"]
    with pytest.raises(Exception, match="one file with one entry"):
        AR.single_entry(got, man, "tweets").collect()
    (folder / "broken.js").write_text("window.YTD.x.part0 = [\n  {\n    \"tweet\" : {\n  oops\n]")
    with pytest.raises(Exception):
        AR.read_parts(spark, str(folder / "broken.js"), "tweet", "struct<id: string>").collect()


def _batch_bursts(spark, small_dir):
    from quillspark.operators.windows import bursts
    b = bursts(table(spark, small_dir, "events"), "user_id", "user_id", "ts", "event_id", 30 * 60 * 1000)
    return sorted((r["user_id"], r["n"]) for r in b.groupBy("user_id", "burst_id").agg(F.count("*").alias("n")).collect())


def test_stream_bursts_lose_nothing_over_many_batches(spark, small_dir):
    folder = FS.new_path(spark, "events")
    table(spark, small_dir, "events").repartition(6, F.col("event_id") % 6).write.parquet(folder)
    delay = S.replay_delay(spark, folder, "*.parquet")
    live = S.run_bursts(spark, folder, FS.new_path(spark, "o"), FS.new_path(spark, "c"), delay, "*.parquet", max_files=1, close=True)
    got = sorted((r["user_id"], r["n_events"]) for r in live.where("user_id <> -1").collect())
    assert got == _batch_bursts(spark, small_dir)


def test_stream_bursts_go_on_after_a_stop(spark, small_dir):
    ev, folder = table(spark, small_dir, "events"), FS.new_path(spark, "events")
    out, ckpt = FS.new_path(spark, "o"), FS.new_path(spark, "c")
    ev.where("event_id < 400").write.mode("append").parquet(folder)
    first = S.run_bursts(spark, folder, out, ckpt, "3 hours", "*.parquet").count()
    ev.where("event_id >= 400").write.mode("append").parquet(folder)
    live = S.run_bursts(spark, folder, out, ckpt, "3 hours", "*.parquet", close=True).where("user_id <> -1")
    got = sorted((r["user_id"], r["n_events"]) for r in live.collect())
    assert first < len(got) and got == _batch_bursts(spark, small_dir)


def _talk(n=400, seed=3):
    """Events of a few conversations (one null, one -1), two senders and a missing one, with equal times, in order of time."""
    rnd, t, rows = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        t += dt.timedelta(milliseconds=rnd.choice([0, 500, 20_000, 60_000, 61_000]))
        rows.append((i, t, rnd.choice([None, -1, 5, 6]), rnd.choice(["ann", "bob", "bob", None]), 0.0, "{}"))
    return rows


def _plain_bursts(rows, gap_ms):
    out, last = {}, {}
    for i, t, conv, sender, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        b = last.get(conv)
        if b and sender is not None and b[0] == sender and (t - b[2]) / dt.timedelta(milliseconds=1) <= gap_ms:
            b[2], b[3] = t, b[3] + 1
        else:
            last[conv] = b = [sender, t, t, 1]
            out.setdefault(conv, []).append(b)
    return sorted(((c, *b) for c, bs in out.items() for b in bs), key=str)


def _files(spark, rows, folder, size):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], S.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_sender_bursts_over_many_files(spark):
    rows = _talk()
    swapped = [r for k in range(0, 400, 20) for r in reversed(rows[k : k + 20])]
    for k in range(95, 395, 100):   # some events arrive a file late
        swapped[k], swapped[k + 10] = swapped[k + 10], swapped[k]
    folder = FS.new_path(spark, "talk")
    _files(spark, swapped, folder, 100)
    progress = []
    delay = S.replay_delay(spark, folder, "*.parquet")
    got = S.run_sender_bursts(spark, folder, FS.new_path(spark, "o"), FS.new_path(spark, "c"), delay, "user_id", "event_type", 60_000, "*.parquet",
                              max_files=1, close=True, progress=progress)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain_bursts(rows, 60_000)
    batch = bursts(spark.createDataFrame(rows, S.EVENTS_SCHEMA), "user_id", "event_type", "ts", "event_id", 60_000)
    assert batch.select("user_id", "burst_id").distinct().count() == got.count()
    assert len([p for p in progress if p.numInputRows]) >= 4
    # once all is let out, the state holds no conversation any more
    assert progress[-1].stateOperators[0].numRowsTotal == 0 < max(p.stateOperators[0].numRowsTotal for p in progress)


def test_state_of_sender_bursts_is_by_bucket(spark):
    """Conversations share the values of the state, which holds no more of them than buckets, however many there are."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i // 1500), i % 1500, ["ann", "bob", None][i % 1500 % 3], 0.0, "{}") for i in range(4500)]
    folder, progress = FS.new_path(spark, "many"), []
    _files(spark, rows, folder, 1500)
    got = S.run_sender_bursts(spark, folder, FS.new_path(spark, "o"), FS.new_path(spark, "c"), "1 second", "user_id", "event_type", 60_000, "*.parquet",
                              max_files=1, close=True, progress=progress)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain_bursts(rows, 60_000)
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in progress) <= 512 and progress[-1].stateOperators[0].numRowsTotal == 0


def test_deliveries_are_as_many_files_for_any_input(spark, small_dir):
    """Every micro-batch goes through the whole state, so their number must not follow the splits of the input."""
    from quillspark import session
    from quillspark.plans.streaming_queries import str_02_again
    name = "spark.sql.files.maxPartitionBytes"
    old, before = spark.conf.get(name), session.scratch_count()
    spark.conf.set(name, "2k")
    try:
        got = str_02_again(spark, small_dir).agg(F.sum("n_attempts")).first()[0]
    finally:
        spark.conf.set(name, old)
    folder = next(p for _, p in session._SCRATCH[before:] if "again-events" in p)
    assert got == table(spark, small_dir, "events").count() and 1 < len(spark.read.parquet(folder).inputFiles()) <= 8


def test_sender_bursts_go_on_after_a_stop(spark):
    rows, folder, out, ckpt = _talk(seed=4), FS.new_path(spark, "talk"), FS.new_path(spark, "o"), FS.new_path(spark, "c")
    run = lambda **kw: S.run_sender_bursts(spark, folder, out, ckpt, "1 second", "user_id", "event_type", 60_000, "*.parquet", **kw)
    _files(spark, rows[:230], folder, 230)
    first = run().count()
    _files(spark, rows[230:], folder, 170)
    got = run(close=True)
    assert 0 < first < got.count() and sorted((tuple(r) for r in got.collect()), key=str) == _plain_bursts(rows, 60_000)


def test_state_of_first_attempts_is_dropped(spark):
    """Ids and windows behind the watermark leave the state, while the result stays that of all events."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), None if i % 7 == 0 else i % 5, "x", 0.0, "{}") for i in range(24 * 30)]
    again = rows + [r for r in rows if r[0] % 4 == 0]
    folder, progress = FS.new_path(spark, "attempts"), []
    _files(spark, sorted(again, key=lambda r: r[1]), folder, 150)
    windows = S.run_folder(spark, folder, lambda e: S.attempts_by_window(e, "user_id", "6 hours"), FS.new_path(spark, "o"), FS.new_path(spark, "c"),
                           "*.parquet", max_files=1, close=True, progress=progress)
    got = {r["user_id"]: (r["event_id"], r["n_attempts"]) for r in S.first_of_windows(windows, "user_id").collect()}
    want = {}
    for i, _, u, *_ in rows:
        want[u] = (want.get(u, (i, 0))[0], want.get(u, (i, 0))[1] + 1)
    assert got == want
    held = [sum(s.numRowsTotal for s in p.stateOperators) for p in progress]
    assert max(held) < 250 and held[-1] <= 3   # of 720 events and 150 windows; at the end the closing event's own


def test_replay_delay_follows_the_order_of_files(spark):
    rows, folder = _talk(), FS.new_path(spark, "talk")
    _files(spark, rows, folder, 100)
    assert S.replay_delay(spark, folder, "*.parquet") == "1 seconds"
    _files(spark, rows[:1], folder, 1)   # the earliest event again, after all others
    assert S.replay_delay(spark, folder, "*.parquet") == f"{int(rows[-1][1].timestamp()) - int(rows[0][1].timestamp()) + 1} seconds"


def test_no_user_is_lost_by_the_end_of_the_stream(spark):
    rows, folder = [(i, dt.datetime(2024, 1, 1, i), [None, -1, 5][i % 3], "x", 0.0, "{}") for i in range(12)], FS.new_path(spark, "users")
    _files(spark, rows, folder, 12)
    got = S.run_bursts(spark, folder, FS.new_path(spark, "o"), FS.new_path(spark, "c"), "1 second", "*.parquet", close=True)
    assert sorted((str(r["user_id"]), r["n_events"]) for r in got.collect()) == sorted((str(u), 1) for u in [None, -1, 5] for _ in range(4))


def test_stream_updates_go_on_after_a_stop(spark, small_dir):
    ev, folder = table(spark, small_dir, "events"), FS.new_path(spark, "events")
    out, ckpt = FS.new_path(spark, "o"), FS.new_path(spark, "c")
    for part in ("event_id >= 300", "event_id < 300"):   # earlier events arrive later
        ev.where(part).write.mode("append").parquet(folder)
        firsts = S.run_updates(S.first_attempts(S.event_stream(spark, folder, "*.parquet", max_files=1), "user_id"), ["user_id"], out, ckpt)
    got = {r["user_id"]: r["event_id"] for r in firsts.collect()}
    want = {r["user_id"]: r["e"] for r in ev.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want


def test_broken_front_matter_is_reported(spark):
    df = spark.createDataFrame([("a", "---\ntitle: [x\n---\nbody"), ("b", "---\ntitle: t\n---\nbody"), ("c", None)], "path string, value string")
    got = {r["doc_key"]: r for r in FM.parse_documents(df).collect()}
    assert got["a"]["error"] and got["a"]["title"] is None and got["a"]["body"] == "body"
    assert got["b"]["error"] is None and got["b"]["title"] == "t" and got["c"]["error"] is None


def test_split_output_uses_more_tasks_than_values(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(8)
    path = FS.new_path(spark, "split")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        FS.write_split(df, path, "k")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    out = spark.read.parquet(path)
    assert out.count() == 200_000
    assert out.select(F.input_file_name()).distinct().count() > 2
