"""No operator changes its result with the size of its input."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import joins as J
from quillspark.operators.listing import ListingSpec, listing
from quillspark.operators.search import fuzzy_score, query_terms


def test_a_listing_of_everything_has_everything(spark):
    df = spark.range(70_000).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("day"))
    out = listing(df, ListingSpec(count=0), date_col="day", id_col="id")
    assert out.count() == 70_000
    r = out.first()
    assert (r["total"], r["more"]) == (70_000, False)


def test_members_of_any_dimension(spark):
    items = spark.createDataFrame([(1, ["m3", "x", "m120000"]), (2, []), (3, None), (4, ["m3", None]), (None, ["m5"]), (4, ["m3", None])], "id int, who array<string>")
    dim = spark.range(130_000).select(F.concat(F.lit("m"), "id").alias("k"), F.concat(F.lit("Name "), "id").alias("v"))
    dim = dim.unionAll(spark.createDataFrame([("m5", "A second name")], "k string, v string"))
    got = sorted((str(r["id"]), r["out"]) if r["out"] is not None else (str(r["id"]), None) for r in J.resolve_members(items, "who", dim, "k", "v", "out").collect())
    assert got == [("1", ["Name 3", "x", "Name 120000"]), ("2", []), ("3", None), ("4", ["Name 3", None]), ("4", ["Name 3", None]), ("None", ["A second name"])]


def test_long_query_terms_are_not_cut(spark):
    word = "abcdefghij" * 4
    df = spark.createDataFrame([(word,)], "t string")
    assert df.select(fuzzy_score({"title": F.col("t")}, word).alias("s")).first()["s"] == 1.0
    assert query_terms("a window") == ["a", "window"] and query_terms("a") == []


def test_optional_parts(spark):
    one = spark.range(1)
    cite = lambda style, *a: one.select(T.citation(style, F.array(F.lit("A")), *a).alias("c")).first()["c"]
    none = F.lit(None).cast("string")
    assert cite("apa", F.lit(2020), F.lit("T"), none) == "A (2020). T." and cite("mla", F.lit(2020), F.lit("T"), none) == 'A. "T." 2020.'
    assert cite("apa", F.lit(2020), F.lit("T"), F.lit("V")) == "A (2020). T. V." and cite("mla", F.lit(2020), F.lit("T"), F.lit("V")) == 'A. "T." V, 2020.'
    assert one.select(T.assemble({"a": F.lit("x"), "b": F.lit("y")}, ["a", "b"], [", "]).alias("c")).first()["c"] == "x, y"


def test_groups_without_a_key(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, None, "de"), (3, "k", "en")], "id int, key string, lang string")
    got = {r["id"]: [x["lang"] for x in r["t"]] for r in J.translations(df, "id", "key", "lang", "t").collect()}
    assert got == {1: ["de"], 2: ["en"], 3: []}


def test_a_cluster_session_needs_a_shared_folder(spark):
    import pytest

    from quillspark import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://somewhere"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Fake:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Fake())


def test_scratch_tables_can_be_removed(spark):
    import os

    from quillspark import session
    kept, session._SCRATCH[:] = session._SCRATCH[:], []
    df = session.materialize(spark.range(3), "gone")
    path = session._SCRATCH[-1][1]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    assert session.clear_scratch(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    session._SCRATCH[:] = kept
