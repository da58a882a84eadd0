"""Window operators against plain-Python references."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import windows as W
from quillspark.operators.aggregates import contingency
from quillspark.operators.setops import fallback


def _bursts_ref(rows, gap_s):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for msgs in by.values():
        msgs.sort(key=lambda r: (r[2], r[0]))
        links = [False] + [(b[2] - a[2]).total_seconds() <= gap_s for a, b in zip(msgs, msgs[1:])]
        for i, r in enumerate(msgs):
            nxt = links[i + 1] if i + 1 < len(msgs) else False
            out[r[0]] = (links[i] or nxt, nxt and not links[i], links[i] and not nxt)
    return out


def test_bursts_vs_loop(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.randint(0, 3), base + dt.timedelta(seconds=rnd.choice([0, 60, 1800, 1801, 3600]) * rnd.randint(0, 40)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, u long, ts timestamp_ntz")
    got = {r["id"]: (r["in_burst"], r["is_first"], r["is_last"])
           for r in W.bursts(df, "u", "u", "ts", "id", 1800 * 1000).collect()}
    assert got == _bursts_ref(rows, 1800)


def test_row_number_scaled_equals_window(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", "hot", "hot", "hot"]), rnd.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, v int").repartition(7)
    got = {r["id"]: r["rn"] for r in W.row_number_scaled(df, [F.col("v").desc(), F.col("id")], keys=["k"]).collect()}
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("id"))
    exp = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp
    glob = {r["id"]: r["rn"] for r in W.row_number_scaled(df, [F.col("id")]).collect()}
    assert glob == {i: i + 1 for i in range(2000)}


def test_attempts_blank_is_one(spark):
    df = spark.createDataFrame([(1, "", 1), (2, "", 2), (3, "p", 5), (4, "p", 3)], "id long, pid string, t int")
    got = {r["id"]: r["attempt"] for r in W.attempts(df, "pid", [F.col("t")]).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1}


def test_contingency_has_zero_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    got = {(r["p"], r["q"]): r["n"] for r in contingency(df, ["p", "q"]).collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 0}


def test_fallback_both_branches(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    empty = a.where("x > 5")
    assert sorted(r[0] for r in fallback(a, b).collect()) == [1]
    assert sorted(r[0] for r in fallback(empty, b).collect()) == [2, 3]


def test_listing_counts(spark, small_dir):
    from quillspark.operators.listing import ListingSpec, listing
    from quillspark.plans.tables import table
    o = table(spark, small_dir, "orders")
    n_f = o.where("o_orderstatus = 'F'").count()
    all_rows = listing(o, ListingSpec(filters={"o_orderstatus": "F"}, count=0), date_col="o_orderdate",
                       id_col="o_orderkey")
    assert all_rows.count() == min(n_f, 65535)
    five = listing(o, ListingSpec(), date_col="o_orderdate", id_col="o_orderkey").collect()
    assert len(five) == 5 and five[0]["more"] is True


def test_segmented_lag_lead_and_running_sum_hot_key(spark):
    # one key holds most rows and is spread over many range partitions
    rows = [(i, "hot" if i % 10 else f"k{i % 3}", i * 7 % 1000) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")      # keep the small test data in many partitions
    try:
        t = W.segments(df, [F.col("v").asc(), F.col("id").asc()], ["k"], "t-seg")
    finally:
        spark.conf.set(key, "true")
    assert t.where("k = 'hot'").select("_pid").distinct().count() > 1
    x = W.prev_next_scaled(t, ["k"], ["id"])
    x = W.running_sum_scaled(x, ["k"], F.col("v"), "rs")
    got = {r["id"]: (r["prev_id"], r["next_id"], r["rs"]) for r in x.collect()}
    w = Window.partitionBy("k").orderBy("v", "id")
    ref = df.select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"))
    assert got == {r["id"]: (r["p"], r["n"], r["rs"]) for r in ref.collect()}


def test_missing_keys_lose_no_rows(spark):
    import datetime as dt
    rows = [(i, None if i % 3 == 0 else "p" if i % 3 == 1 else "", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i * 3 % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v int").repartition(5)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    for f in (lambda s: W.bursts(df, "k", "k", "ts", "id", 1_800_000, skew_safe=s), lambda s: W.neighbours(df, "k", ["ts", "id"], "id", skew_safe=s),
              lambda s: W.positions(df, ["k"], ["id"], skew_safe=s), lambda s: W.stage_durations(df, "k", "ts", "id", skew_safe=s)):
        assert f(True).count() == 40 and same(f(True), f(False))
    got = {r["id"]: r["attempt"] for r in W.attempts(df, "k", [F.col("ts"), F.col("id")]).collect()}
    assert got == {i: 1 if i % 3 == 2 else i // 3 + 1 for i in range(40)}


def test_duplicate_report_counts_missing_as_text(spark):
    df = spark.createDataFrame([(1, 1, "X"), (1, 2, None), (2, 1, None), (2, 2, None), (3, 1, "X"), (3, 2, "X"), (None, 1, "Y"), (None, 2, "Y")], "k int, o int, v string")
    got = {(r["k"], r["o"]): (r["n"], r["flags_concat"], r["dup_equal"]) for r in W.duplicate_report(df, ["k"], "v", ["o"]).collect()}
    assert got[1, 1] == (2, "XNA", 0) and got[2, 2] == (2, "NANA", 1) and got[3, 1] == (2, "XX", 1) and got[None, 1] == (2, "YY", 1)


def test_contingency_has_no_limit_on_values(spark):
    df = spark.createDataFrame([(f"a{i % 7}", i) for i in range(300)], "p string, q long")
    out = contingency(df, ["p", "q"], chunk=16)
    assert out.count() == 7 * 300 and out.agg(F.sum("n")).first()[0] == 300
