"""A stored inverted index for the weighted fuzzy search (SEA-02, SEA-05).

``build_index`` reads the corpus once and writes, under one folder of the shared file system:

* ``postings`` (token, field, id): where each distinct token of a field occurs, in folders by a hash of the token and sorted by
  token inside; a token of very many rows is split over several files;
* ``grams`` (gram, nth, length, token): the padded character pairs of each token of the dictionary, sorted by pair, and
  ``counts``, how many tokens hold each;
* ``long`` (token, length): the tokens of over ``LONG`` characters, which have no pairs;
* ``rows``: the id and the small columns that results show.

A query never reads a text. Each of its terms is looked up in the dictionary: a token as similar as the threshold asks differs
by at most ``d = threshold * longer length`` edits, so the two share at least ``longer + 1 - 2d`` pairs, and a token that holds
none of the term's rarest ``pairs - shared + 1`` cannot be one. The few candidates are compared exactly (``search.similarity``).
The tokens found, each with its similarity, then select postings; a row's score is built from the best similarity per field and
term, by the same formula as the scan in ``search``.

Ids are unique and not null. A null field has no tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.arrays import let
from quillspark.operators.search import FIELD_WEIGHTS, THRESHOLD, query_terms, similarity, tokens

SHARDS, LONG = 16, 64
#: Tokens up to which a query's matches become literals, so that whole folders and row groups of postings are skipped.
LITERALS = 2_000
START, END = "\u0002", "\u0003"


def _shard(token: Column, shards: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """An index that has been written; its tables are read when a query needs them."""
    spark: SparkSession
    path: str
    id_col: str
    id_type: str
    fields: tuple[str, ...]
    shards: int

    def table(self, name: str) -> DataFrame:
        kinds = {"postings": f"token string, field int, id {self.id_type}, shard int", "grams": "gram string, nth int, length int, token string",
                 "counts": "gram string, nth int, n bigint", "long": "token string, length int"}
        reader = self.spark.read.schema(kinds[name]) if name in kinds else self.spark.read
        return reader.parquet(f"{self.path}/{name}")


def token_grams(token: Column) -> Column:
    """The pairs of neighbouring characters of a token between two end marks, each with the number of its equals up to it."""
    marked = F.concat(F.lit(START), token, F.lit(END))
    pairs = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))
    nth = lambda p, g, i: F.size(F.filter(F.slice(p, F.lit(1), i + 1), lambda x: x == g))
    return let(pairs, lambda p: F.transform(p, lambda g, i: F.struct(g.alias("gram"), nth(p, g, i).alias("nth"))))


def plain_grams(token: str) -> list[tuple[str, int]]:
    marked = START + token + END
    pairs = [marked[i : i + 2] for i in range(len(marked) - 1)]
    return [(g, pairs[: i + 1].count(g)) for i, g in enumerate(pairs)]


def build_index(corpus: DataFrame, fields: dict[str, Column], id_col: str, path: str, keep: list[str] | None = None, shards: int = SHARDS) -> SearchIndex:
    """Write the index of ``fields`` (name -> text column) of ``corpus`` to ``path``; ``keep`` are the columns that results show."""
    spark, names = corpus.sparkSession, tuple(fields)
    held = lambda n, c: F.transform(tokens(c), lambda t: F.struct(t.alias("token"), F.lit(n).alias("field")))
    each = F.concat(*[F.coalesce(held(n, c), F.array()) for n, c in enumerate(fields.values())])
    postings = corpus.select(F.col(id_col).alias("id"), F.explode(each).alias("x")).select("x.token", "x.field", "id")
    postings = postings.withColumn("shard", _shard(F.col("token"), shards)).hint("rebalance", F.col("shard"))
    postings.sortWithinPartitions("shard", "token", "field").write.partitionBy("shard").parquet(f"{path}/postings")
    corpus.select(id_col, *(keep or [])).write.parquet(f"{path}/rows")
    index = SearchIndex(spark, path, id_col, corpus.schema[id_col].dataType.simpleString(), names, shards)
    dictionary = index.table("postings").select("token").distinct().withColumn("length", F.length("token"))
    dictionary.where(F.col("length") > LONG).write.parquet(f"{path}/long")
    grams = dictionary.where(F.col("length") <= LONG).select("length", "token", F.explode(token_grams(F.col("token"))).alias("g"))
    grams = grams.select("g.gram", "g.nth", "length", "token").hint("rebalance", F.col("gram"))
    grams.sortWithinPartitions("gram", "nth", "length").write.parquet(f"{path}/grams")
    index.table("grams").groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return index


def _one_of(column: Column, values: list, chunk: int = 10) -> Column:
    """``isin``, and again in small sorted groups, each of which the Parquet reader compares with the bounds of a row group. Most
    rows that are read fail the first, which is one look into a set, so that few go through the groups."""
    values = sorted(set(values))
    groups = [column.isin(values[i : i + chunk]) for i in range(0, len(values), chunk)]
    return column.isin(values) & reduce(lambda a, b: a | b, groups, F.lit(False))


def _lengths(term: str, threshold: float) -> range:
    """Lengths that a token similar to ``term`` can have."""
    n = len(term)
    return range(math.ceil((1 - threshold) * n - 1e-9), math.floor(n / (1 - threshold) + 1e-9) + 1)


def _rarest(term: str, threshold: float, counts: dict[tuple[str, int], int]) -> list[tuple[str, int]]:
    """The rarest pairs of ``term`` of which every similar token holds at least one."""
    n, grams = len(term), plain_grams(term)
    shared = min(max(n, m) + 1 - 2 * math.floor(threshold * max(n, m) + 1e-9) for m in _lengths(term, threshold))
    return sorted(grams, key=lambda g: (counts.get(g, 0), g))[: len(grams) - shared + 1]


def matching_tokens(index: SearchIndex, terms: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(token, term, ratio): tokens of the dictionary that are as similar to a term as ``threshold`` asks."""
    spark = index.spark
    wanted = {g for t in terms for g in plain_grams(t)}
    known = index.table("counts").where(_one_of(F.col("gram"), [g for g, _ in wanted])).collect() if wanted else []  # a few rows a pair of the query
    counts = {(r["gram"], r["nth"]): r["n"] for r in known}
    found = spark.createDataFrame([], "token string, term int, ratio double")
    for k, term in enumerate(terms):
        lengths, rare = _lengths(term, threshold), _rarest(term, threshold, counts)
        holds = reduce(lambda a, b: a | b, [(F.col("gram") == g) & (F.col("nth") == n) for g, n in rare])
        near = index.table("grams").where(F.col("length").between(lengths[0], lengths[-1]) & holds).select("token")
        if lengths[-1] > LONG:
            near = near.unionByName(index.table("long").where(F.col("length").between(lengths[0], lengths[-1])).select("token"))
        near = near.distinct().select("token", F.lit(k).alias("term"), similarity(F.col("token"), term, threshold).alias("ratio"))
        found = found.unionByName(near.where(F.col("ratio") > 0))
    return found


def index_scores(index: SearchIndex, query: str, weights: dict[str, float] = FIELD_WEIGHTS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, score): every row of positive score. Only postings of matching tokens are read."""
    terms = query_terms(query)
    found = matching_tokens(index, terms, threshold)
    postings = index.table("postings")
    few = found.limit(LITERALS + 1).collect()  # at most LITERALS + 1 tokens
    if len(few) <= LITERALS:
        found = index.spark.createDataFrame(few, found.schema)
        shards = [r["shard"] for r in found.select(_shard(F.col("token"), index.shards).alias("shard")).distinct().collect()]
        postings = postings.where(F.col("shard").isin(shards) & _one_of(F.col("token"), [r["token"] for r in few]))
        found = F.broadcast(found)  # LITERALS rows at most
    hits = postings.join(found, "token")
    best = lambda f, t: F.coalesce(F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col("ratio"))), F.lit(0.0)).alias(f"r{f}_{t}")
    rows = hits.groupBy("id").agg(*[best(f, t) for f in range(len(index.fields)) for t in range(len(terms))] or [F.lit(0.0).alias("none")])
    total, score = sum(weights[f] for f in index.fields), F.lit(0.0)
    for f, name in enumerate(index.fields):
        per = reduce(lambda a, t: a + F.col(f"r{f}_{t}"), range(len(terms)), F.lit(0.0))
        score = score + F.lit(weights[name]) * (per / F.lit(float(max(len(terms), 1))))
    return rows.select(F.col("id").alias(index.id_col), (score / F.lit(total)).alias("score"))


def index_search(index: SearchIndex, query: str, k: int = 10, digits: int | None = None, weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """SEA-02 from the index: the ``k`` best rows (ties by id)."""
    scores = index_scores(index, query, weights)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return scores.orderBy(F.col("score").desc(), F.col(index.id_col)).limit(k)


def index_hits(index: SearchIndex, query: str, weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Every row of positive score with the columns that results show."""
    return index_scores(index, query, weights).join(index.table("rows"), index.id_col)
