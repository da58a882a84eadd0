"""Groups of any size: ordered texts, pages, classes, displays, feeds and spans."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import arrays as AR
from quillspark.operators import aggregates as A
from quillspark.operators import joins as J
from quillspark.operators import setops as SO
from quillspark.operators import windows as W
from quillspark.sources import sinks as SK


@pytest.mark.parametrize("hot", [10, 1000])
def test_a_hot_group_is_joined_over_many_tasks(spark, hot):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")   # keep these few rows in several tasks
    try:
        _hot_group(spark, hot)
    finally:
        spark.conf.set(name, "true")


def _hot_group(spark, hot):
    rnd = random.Random(1)
    rows = [("big" if i % 3 else rnd.choice(["a", "b", None]), i // 2, rnd.choice(["x", "y", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, v string").repartition(5)
    got = {r["g"]: r["t"] for r in W.concat_groups(df, ["g"], ["o"], F.coalesce("v", F.lit("NA")), "t", "-", hot).collect()}
    want = {}
    for g, _, v in sorted(rows, key=lambda r: (r[1], r[2] or "NA")):
        want.setdefault(g, []).append(v or "NA")
    assert got == {g: "-".join(v) for g, v in want.items()}
    if hot == 10:
        t = W.segments(df.where("g = 'big'"), [F.col("o").asc()], ["g"], "x")
        assert t.select("_pid").distinct().count() > 1   # the hot group's rows are sorted in several tasks


def test_duplicate_groups_hold_their_text_once(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, None), (2, 2, "NA"), (3, 1, "x"), (None, 1, "n")], "g int, o int, v string")
    got = {r["g"]: tuple(r)[1:] for r in W.duplicate_groups(df, ["g"], "v", ["o"]).collect()}
    assert got == {1: (2, "aa", 1), 2: (2, "NANA", 1), 3: (1, "x", 0), None: (1, "n", 0)}
    assert W.duplicate_report(df, ["g"], "v", ["o"]).count() == 6


def test_displays_in_blocks_of_columns(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("rst"), rnd.randrange(23)) for _ in range(60)] + [(None, 1), ("r", None), ("only", 99)]
    blocks = list(A.contingency_display(spark.createDataFrame(rows, "a string, b int"), "a", "b", block=10))
    names = [c for b in blocks for c in b.columns[1:]]
    assert names == [str(x) for x in sorted({b for a, b in rows if a and b is not None})] and all(len(b.columns) <= 11 for b in blocks)
    for b in blocks:
        table = {r["a"]: r.asDict() for r in b.collect()}
        assert set(table) == {"r", "s", "t", "only"}
        assert all(table[a][c] == sum(x == (a, int(c)) for x in rows) for a in table for c in b.columns[1:])
    assert list(A.contingency_display(spark.createDataFrame([], "a string, b int"), "a", "b")) == []


def test_nested_pages_are_bounded(spark):
    rows = [(i, dt.date(2024, 1 + i % 2, 1 + i % 5) if i % 11 else None) for i in range(130)]
    df = spark.createDataFrame(rows, "id int, day date")
    got = A.nested_by_date(df, "day", "id", "yyyy-MM", ["id", "day"], page=20).collect()
    assert all(len(r["items"]) <= 20 for r in got)
    for g in ("2024-01", "2024-02", None):
        pages = sorted((r for r in got if r["group"] == g), key=lambda r: r["page"])
        items = [x["id"] for r in pages for x in r["items"]]
        own = [r for r in rows if (r[1].strftime("%Y-%m") if r[1] else None) == g]
        assert items == [i for i, _ in sorted(own, key=lambda r: (r[1] or dt.date.min, r[0]), reverse=True)]
        assert all(r["n_in_group"] == len(own) for r in pages) and [r["page"] for r in pages] == list(range(1, len(pages) + 1))


def test_every_sibling_is_reached_unknown_languages_too(spark):
    rows = [(1, "k", "en"), (2, "k", "de"), (3, "k", None), (4, "k", "en"), (5, None, "en"), (6, None, None), (7, "z", "fr")]
    df = spark.createDataFrame(rows, "id int, key string, lang string")
    langs = {r["id"]: [(x["lang"], x["_rep"]) for x in r["t"]] for r in J.translations(df, "id", "key", "lang", "t").collect()}
    assert langs[1] == [(None, 3), ("de", 2)] and langs[3] == [("de", 2), ("en", 1)] and langs[6] == [("en", 5)] and langs[7] == []
    members, classes = J.sibling_classes(df, "id", "key", "lang")
    of = {}
    for r in members.collect():
        of.setdefault(r["class_id"], set()).add((r["id"], r["lang"]))
    assert of == {1: {(1, "en"), (2, "de"), (3, None), (4, "en")}, 5: {(5, "en"), (6, None)}, 7: {(7, "fr")}}
    assert {r["class_id"]: (r["n"], [tuple(x) for x in r["languages"]]) for r in classes.collect()}[1] == (4, [(None, 1), ("de", 1), ("en", 2)])


def test_spans_of_very_many_hits(spark):
    """100,000 hits in one text are found and merged in seconds."""
    df = spark.createDataFrame([("the " * 100_000,), (None,), ("",), ("THE thethe x",)], "t string")
    began = time.time()
    spans = F.concat(AR.hit_spans("t", "the"), AR.hit_spans("t", "he "))
    got = [r["m"] for r in df.select(AR.merge_spans(spans).alias("m")).collect()]
    assert time.time() - began < 60
    assert len(got[0]) == 100_000 and tuple(got[0][-1]) == (399_996, 399_999)
    assert got[1] is None and got[2] == [] and [tuple(x) for x in got[3]] == [(0, 3), (4, 6), (7, 10)]


def test_a_feed_of_every_collection_and_of_the_site(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i), ["talk", "post", None][i % 3]) for i in range(12)]
    p = spark.createDataFrame(rows, "id int, day timestamp_ntz, section string")
    name = F.col("collection")
    text = F.col("id").cast("string")
    feed = {r["collection"]: r for r in SK.collection_feed(p, "Site", name, F.lit("/"), "section", "day", "id", 3, text, text, text).collect()}
    assert set(feed) == {"talk", "post", None} and feed[None]["title"] == "Site" and feed["talk"]["title"] == "talk | Site"
    assert [x["title"] for x in feed[None]["item"]] == ["11", "10", "9"] and [x["title"] for x in feed["talk"]["item"]] == ["9", "6", "3"]


def test_records_of_sites_leave_out_what_is_missing(spark):
    none, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    one = spark.range(1)
    firm = SK.organization_record(F.lit("Organization"), F.lit("u"), F.lit("n"), F.lit("l"), none, num, F.lit(1.0), None, none)
    shop = SK.organization_record(F.lit("LocalBusiness"), F.lit("u"), F.lit("n"), F.lit("l"), F.lit("i"), F.lit(2.0), F.lit(1.0), {"postalCode": none}, F.lit("1"))
    read = lambda c: json.loads(one.select(c.alias("j")).first()["j"])
    assert set(read(firm)) == {"@context", "@type", "@id", "name", "logo", "url"}
    assert read(shop)["geo"] == {"@type": "GeoCoordinates", "latitude": 2.0, "longitude": 1.0} and read(shop)["address"] == {"@type": "PostalAddress", "postalCode": ""}
    assert set(read(SK.website_record(F.lit("u"), F.lit(False)))) == {"@context", "@type", "url"}
    assert read(SK.website_record(F.lit("u"), F.lit(True)))["potentialAction"]["target"] == "u?q={search_term_string}"


def test_fallback_stops_at_the_first_row(spark):
    a, b = spark.range(3), spark.range(10, 12)
    assert SO.fallback(a, b).count() == 3 and sorted(r["id"] for r in SO.fallback(a.where("id > 5"), b).collect()) == [10, 11]
    assert "Limit 1" in SO.fallback(a, b)._jdf.queryExecution().optimizedPlan().toString()
