"""E2 preparation steps on hand-written frames (Q12: exclusions are a table)."""

import datetime as dt


from quillspark.operators.prep import Milestones, classify_validity, page_times, prepare


def test_page_times_earliest_and_durations(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", "p1", t0), ("a", "p2", t0 + dt.timedelta(seconds=90)),
                                 ("a", "p1", t0 + dt.timedelta(seconds=5))], "pid string, page string, ts timestamp_ntz")
    m = Milestones(pages=["p1", "p2"], stages={"time_total": ("p1", "p2")})
    r = page_times(log, "pid", "page", "ts", m).first()
    assert r["page_p1"] == t0 and r["time_total"] == 90.0


def test_exclusion_table_marks_duplicates(spark):
    df = spark.createDataFrame([("x", 1, 10.0), ("y", 1, 10.0), ("", 1, 10.0)],
                               "code string, attempt long, time_a double")
    ex = spark.createDataFrame([("y",)], "code string")
    got = {r["code"]: (r["invalid"], r["valid"]) for r in classify_validity(df, "code", ["time_a"], ex).collect()}
    assert got == {"x": ("", "yes"), "y": ("duplicate", ""), "": ("auto_advanced", "")}


def test_prepare_masks_invalid_and_drops_private(spark):
    t0 = dt.datetime(2024, 1, 1)
    parts = spark.createDataFrame([(1, 0, "P1", 5.0, "3"), (2, 0, "P1", 7.0, "4"), (3, 1, "P3", 1.0, "0")],
                                  "uid long, grp long, code string, pay double, edu string")
    log = spark.createDataFrame([(u, p, t0 + dt.timedelta(minutes=u * 10, seconds=20 * i)) for u in (1, 2, 3)
                                 for i, p in enumerate(["s", "e"])], "uid long, page string, ts timestamp_ntz")
    m = Milestones(pages=["s", "e"], stages={"time_total": ("s", "e")})
    out = prepare(parts, log, pid="uid", page="page", ts="ts", id_col="code", group="grp", m=m,
                  payoffs=["pay"], human=["edu"], private=["code"])
    rows = {r["uid"]: r for r in out.collect()}
    assert "code" not in out.columns
    assert rows[2]["invalid"] == "duplicate" and rows[2]["edu"] is None   # second attempt of P1, masked
    assert rows[1]["invalid"] == "" and rows[1]["edu"] is None            # valid, but under 30 s in total
    assert rows[1]["maximum1"] == 5.0 + 7.0 + 600.0
