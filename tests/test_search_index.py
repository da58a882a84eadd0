"""The stored search index against the scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search as S
from quillspark.operators import search_index as SI

FIELDS = ("title", "summary", "content", "tags")


def _corpus(spark, seed, n=150):
    rnd = random.Random(seed)
    stems = ["window", "winder", "wind", "joint", "join", "joins", "état", "etage", "spark", "sparkle", "a", "to", "the", "x" * 70, "y" * 100, "banana", "bananas", "ananas"]

    def word():
        w = rnd.choice(stems)
        if rnd.random() < 0.4:   # a misspelling
            i = rnd.randrange(len(w) + 1)
            w = w[:i] + rnd.choice(["", "é", "q", "an"]) + w[i + rnd.randrange(2):]
        return w.upper() if rnd.random() < 0.1 else w
    text = lambda k: None if rnd.random() < 0.05 else " ".join(["the"] * (rnd.random() < 0.5) + [word() for _ in range(rnd.randint(0, k))])
    rows = [(f"doc-{i}", text(4), text(8), text(40), text(2), f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "object_id string, title string, summary string, content string, tags string, section string")


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    c = _corpus(spark, 1)
    fields = {f: F.col(f) for f in FIELDS}
    return c, fields, SI.build_index(c, fields, "object_id", str(tmp_path_factory.mktemp("index")), keep=["section"], shards=4)


@pytest.mark.parametrize("query", ["window", "wind join", "etat", "ÉTAT", "bananna", "the", "an", "zzzzzz", "x" * 66, "y" * 97 + " spark", "w", "", "to the", "ananas banana sparkle"])
def test_scores_equal_those_of_the_scan(pair, query):
    c, fields, index = pair
    want = {r["object_id"]: r["score"] for r in S.search(c, fields, query, "object_id", k=10_000).collect()}
    got = {r["object_id"]: r["score"] for r in SI.index_search(index, query, k=10_000).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    top = [tuple(r) for r in S.search(c, fields, query, "object_id", k=7, digits=6).collect()]
    assert [tuple(r) for r in SI.index_search(index, query, k=7, digits=6).collect()] == top


def test_many_matches_go_by_a_join(pair, monkeypatch):
    c, fields, index = pair
    want = {r["object_id"] for r in S.search(c, fields, "wind join", "object_id", k=10_000).collect()}
    monkeypatch.setattr(SI, "LITERALS", 1)
    assert {r["object_id"] for r in SI.index_hits(index, "wind join").collect()} == want


def test_a_query_reads_the_index_only(pair):
    """No text is read, the dictionary is asked for a few pairs, and only the folders of the matching tokens are opened."""
    _, _, index = pair
    for df in (SI.index_search(index, "sparkle"), SI.index_hits(index, "sparkle")):
        assert all(f"{index.path}/" in f for f in df.inputFiles())
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan and "PartitionFilters: [shard" in plan and "PushedFilters" in plan
    counts = {(r["gram"], r["nth"]): r["n"] for r in index.table("counts").collect()}
    asked = sum(counts.get(g, 0) for g in SI._rarest("sparkle", S.THRESHOLD, counts))
    assert asked * 4 < sum(counts.values())


def test_similar_tokens_share_a_rare_pair():
    """Every token within the threshold holds one of the pairs that are looked up, whatever the counts are."""
    rnd = random.Random(4)
    for _ in range(3000):
        term = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))
        token = term
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(token) + 1)
            token = token[:i] + rnd.choice(["", "a", "b", "ca"]) + token[i + rnd.randrange(2):]
        if not token:
            continue
        row = list(range(len(token) + 1))
        for i, a in enumerate(term, 1):
            row, last = [i], row
            for j, b in enumerate(token, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
        if 1 - row[-1] / max(len(term), len(token)) >= 0.7:
            counts = {g: rnd.randrange(5) for g in SI.plain_grams(term)}
            assert len(token) in SI._lengths(term, 0.3)
            assert set(SI._rarest(term, 0.3, counts)) & set(SI.plain_grams(token))


def test_rows_meet_the_whole_set_before_its_groups(spark):
    """A row of no matching token is told by one look into a set, and not by a comparison with every group."""
    df = spark.range(90).select(F.concat(F.lit("t"), F.col("id")).alias("token"))
    found = df.where(SI._one_of(F.col("token"), [f"t{i}" for i in range(40, 140)]))
    assert sorted(r["token"] for r in found.collect()) == sorted(f"t{i}" for i in range(40, 90))
    assert "INSET" in found._jdf.queryExecution().optimizedPlan().toString()


def test_empty_corpus(spark, tmp_path):
    c = _corpus(spark, 2).limit(0)
    index = SI.build_index(c, {f: F.col(f) for f in FIELDS}, "object_id", str(tmp_path))
    assert SI.index_search(index, "window").collect() == []
