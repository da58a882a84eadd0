"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by centroids of its own; a cell is a pair of centroids. A query goes through the
cells by the sum of its halves' squared distances to the two centroids, in order, by a heap over the pairs, until it has
passed ``budget`` entries; the entries of those cells are reranked by their exact distance.

The centroids come from a sample of at most about ``SAMPLE`` vectors, chosen by hash. The same sample sets the budget:
sample queries are answered by brute force within the sample, and the budget is the share of entries that holds
``RECALL`` of their true neighbours, as a share of all vectors. Every vector is indexed. Cells lie in blocks of about
``BLOCK`` entries (a larger cell is dealt over several blocks), a query is sent once to each block that holds cells of its
list, and each block answers with its best k. Queries are dealt over as many tasks a block as keep to about ``ASKS`` each;
the block's entries go to each of these.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest (ties go to smaller ids), so larger groups
shrink to these before anything meets. Vectors that are null, zero or hold a null or non-finite component take no part;
null ids take no part either. Distances exist between vectors of one length only: every length has an index of its own and
is searched by itself. Rows that repeat an id and vector count once. An empty table gives no rows; other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import by_value, hash_sample, written

by_value(__name__)

SAMPLE, TUNING, RECALL, BLOCK, ASKS, PER_CELL, MOST, ROUNDS = 20_000, 200, 0.96, 8_192, 4_096, 12, 64, 8


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def centroids(rows: np.ndarray, k: int) -> np.ndarray:
    """K-means with seeded starts; a centroid that loses all its rows stays where it is."""
    start = np.random.default_rng(11).permutation(len(rows))[:k]
    c = rows[np.sort(start)].copy()
    for _ in range(ROUNDS):
        near = _square(rows, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, rows)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """Two codebooks, the number of entries in each cell, the blocks that the cells lie in, and the budget."""

    def __init__(self, rows: np.ndarray):
        self.half = rows.shape[1] // 2
        k = int(np.clip(round((len(rows) / PER_CELL) ** 0.5), 1, MOST))
        self.books = [centroids(np.ascontiguousarray(x), k) for x in (rows[:, : self.half], rows[:, self.half :])]
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), dtype=np.int64)
        self.share = 1.0

    def distances(self, rows: np.ndarray) -> list[np.ndarray]:
        return [_square(x, c) for x, c in zip((rows[:, : self.half], rows[:, self.half :]), self.books)]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.distances(rows)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def order(self, a: np.ndarray, b: np.ndarray):
        """Cells by a[i] + b[j], least first: a pair enters the heap when the pair before it on either side has left."""
        ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
        sa, sb = a[ia].tolist(), b[ib].tolist()
        heap, reached = [(sa[0] + sb[0], 0, 0)], [0] * len(sa)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(ia[i]) * len(ib) + int(ib[j])
            if j + 1 < len(sb):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(sa):
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))

    def visit(self, a: np.ndarray, b: np.ndarray, budget: float) -> list[int]:
        """Filled cells in order until their entries reach the budget."""
        out, passed, counts = [], 0, self.counts.ravel()
        for cell in self.order(a, b):
            if counts[cell]:
                out.append(cell)
                passed += int(counts[cell])
                if passed >= budget:
                    break
        return out

    def tune(self, rows: np.ndarray, k: int) -> None:
        """Sets the share of entries that a query passes, from the sample's own neighbours."""
        cell = self.cells(rows)
        self.counts = np.bincount(cell, minlength=self.counts.size).reshape(self.counts.shape)
        queries = rows[:: max(1, len(rows) // TUNING)]
        a, b = self.distances(queries)
        need, counts = [], self.counts.ravel()
        for q in range(len(queries)):
            near = np.argsort(((rows - queries[q]) ** 2).sum(1), kind="stable")[: k + 1]
            passed = np.zeros(self.counts.size, dtype=np.int64)
            total = 0
            for c in self.order(a[q], b[q]):
                total += int(counts[c])
                passed[c] = total
            need += passed[cell[near]].tolist()
        self.share = float(np.quantile(np.array(need) / len(rows), RECALL)) if need else 1.0


def build(rows: DataFrame, key: str, vector: str, total: int, k: int) -> MultiIndex | None:
    """The index of ``rows`` (usable vectors of one length): codebooks and budget from the sample, counts from all."""
    sample = hash_sample(rows, key, SAMPLE, total, 13).select(key, vector).limit(2 * SAMPLE).toPandas().sort_values(key)
    if not len(sample):
        return None
    data = np.stack(sample[vector].to_numpy()).astype(np.float64)
    index = MultiIndex(data)
    index.tune(data, k)
    return index


def nearest(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank from 1, ``key``, score): for each usable row for which ``is_query`` holds, its ``k`` nearest other
    rows found, by Euclidean distance in double precision, ties to smaller ids."""
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = written(rows.dropDuplicates(["id", "v"]), "vectors")
    out = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    for size in sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()):  # lengths: one a model of vectors
        out = out.unionByName(_nearest_of_length(rows.where(F.size("v") == size), key, k))
    return out


def _nearest_of_length(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``nearest`` among rows (id, v, asks) of one length."""
    spark = rows.sparkSession
    few = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = written(rows.select("id", "v").withColumn("__n", few).where(F.col("__n") <= k + 1).drop("__n"), "entries")
    total = entries.count()
    index = build(entries, "id", "v", total, k)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.stack([np.asarray(x) for x in batch.column(1).to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index.cells(v).astype(np.int32))], ["id", "v", "cell"])
    celled = written(entries.mapInArrow(assign, "id long, v array<double>, cell int"), "cells")
    for r in celled.groupBy("cell").count().collect():  # a row a cell, MOST * MOST at most
        index.counts.ravel()[r["cell"]] = r["count"]
    # blocks: cells in order, filled up to BLOCK entries; a cell of more takes several blocks of its own
    first, blocks, room = {}, 0, 0
    for cell in np.flatnonzero(index.counts.ravel()).tolist():
        n = int(index.counts.ravel()[cell])
        if n > room:
            first[cell] = (blocks, -(-n // BLOCK))
            blocks += first[cell][1]
            room = first[cell][1] * BLOCK - n if first[cell][1] == 1 else 0
        else:
            first[cell] = (blocks - 1, 1)
            room -= n
    budget = index.share * total
    spans = spark.createDataFrame([(c, b, n) for c, (b, n) in first.items()], "cell int, base int, spread int")
    placed = celled.join(F.broadcast(spans), "cell").select(  # MOST * MOST rows at most
        (F.col("base") + F.pmod(F.xxhash64("id"), F.col("spread")).cast("int")).alias("block"), "id", "v", "cell")

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vs = batch.column(0).to_pylist(), batch.column(1)
            v = np.stack([np.asarray(x) for x in vs.to_numpy(zero_copy_only=False)])
            a, b = index.distances(v)
            for q in range(len(ids)):
                lists: dict[int, list[int]] = {}
                for cell in index.visit(a[q], b[q], budget):
                    base, n = first[cell]
                    for block in range(base, base + n):
                        lists.setdefault(block, []).append(cell)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(lists), pa.int32()), pa.array([ids[q]] * len(lists), pa.int64()), pa.array([v[q].tolist()] * len(lists), pa.list_(pa.float64())),
                     pa.array(list(lists.values()), pa.list_(pa.int32()))], ["block", "query_id", "v", "cells"])
    asked = rows.where("asks").select("id", "v").mapInArrow(route, "block int, query_id long, v array<double>, cells array<int>")

    def answer(asks, held):
        import pandas as pd
        out = []
        if len(asks) and len(held):
            held = held.sort_values(["cell", "id"])
            ids, cell, v = held["id"].to_numpy(), held["cell"].to_numpy(), np.stack(held["v"].to_numpy())
            for query, q, cells in zip(asks["query_id"], asks["v"], asks["cells"]):
                cells = np.sort(np.asarray(cells))
                at = np.flatnonzero(np.isin(cell, cells) & (ids != query))
                d = np.sqrt(((v[at] - np.asarray(q)) ** 2).sum(axis=1))
                if len(d) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    at, d = at[near], d[near]
                best = np.lexsort((ids[at], d))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[best]], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    shares = max(1, -(-rows.where("asks").count() // ASKS))
    asked = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    placed = placed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    found = asked.groupBy("block", "share").cogroup(placed.groupBy("block", "share")).applyInPandas(answer, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")
