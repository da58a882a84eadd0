"""Ranked lexical search: term at a time, with limited accumulators.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased. For each item (a query
text) the ``k`` documents of highest score are found, exactly. All scores are whole numbers:

* weight of a term: floor(1000 * ln((2N + 2) / (2df + 1))), N documents with a term, df of them with this one;
* length factor of a document of n terms: m = 100 - 90 + (90 * n * N) div L, L terms in all;
* score: the sum over the item's distinct terms of weight * ((10^9 * tf) div (1000 * tf + 8 * m)).

The index has a row per document: its number of terms, and those of its terms that occur in items with their counts; every
text is read once. The search goes over blocks of ``BLOCK`` documents, whose lists are inverted (term -> documents). Terms of
an item come rarest first. A document gets an accumulator when a term first meets it; before each term, the most that this and
all later terms can add (each term's highest contribution in the block, from its list) is compared with the k-th best score so
far: of documents finished in earlier blocks of the task, and of the partial scores here, which only grow. Once the rest is
lower, no document without an accumulator can be among the best, so none is created any more; the accumulators that exist are
then brought up to date exactly, by looking up only their documents in the longer lists. Each task gives its k best documents of an
item; these are merged in two steps, so that no task receives one row from every task of a large job.

Items are taken in blocks of about ``ITEM_BYTES`` of text (counted first), so what is sent to executors is bounded; with more
items the documents are read once for each block. An item's own text is held whole.

A null or empty text has no term: such a document counts nowhere, such an item has no rows. Very long texts are read piece by
piece, equal scores go to smaller ids. Rows that repeat a document id are documents of their own; rows that repeat an item's
id are one item with all their terms. Documents with a null id count in the statistics but are not ranked; a null item id is
an id like any other. Empty tables give no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_words, by_value, slices, written

by_value(__name__)

BLOCK, ITEM_BYTES, MERGE = 16_384, 16 << 20, 64
INDEX = "id long, n long, terms array<int>, counts array<int>, totals array<long>"


@dataclass(frozen=True)
class Item:
    """An item's id, its terms, rarest first, by number, and their weights."""
    item: int | None
    terms: np.ndarray
    weights: np.ndarray


def term_counts(text: bytes) -> Counter:
    found: Counter = Counter()
    for words in ascii_words(text):
        found.update(words)
    return found


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, terms): the distinct terms of each item, as binary, in order."""
    def run(batches):
        for batch in slices(batches, 64):
            sets = [sorted(term_counts(t or b"")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.binary()))], ["item", "terms"])
    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "item long, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()
    return found.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def build_index(docs: DataFrame, key: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """A row for each document with an id that holds a term of ``number``, and one per task with its totals: documents with
    a term, their terms, and documents that hold each numbered term."""
    def run(batches):
        total = np.zeros(len(number) + 2, dtype=np.int64)
        names, many = ["id", "n", "terms", "counts", "totals"], pa.list_(pa.int32())
        for batch in slices(batches):
            ids, ns, terms, counts = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = term_counts(t or b"")
                if not found:
                    continue
                n, held = found.total(), number.keys() & found.keys()
                at = np.fromiter((number[w] for w in held), np.int64, len(held))
                total[:2] += (1, n)
                total[at + 2] += 1
                if i is not None and len(at):
                    ids.append(i)
                    ns.append(n)
                    terms.append(at.astype(np.int32))
                    counts.append(np.fromiter((found[w] for w in held), np.int32, len(held)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, many), pa.array(counts, many),
                                              pa.nulls(len(ids), pa.list_(pa.int64()))], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, many), pa.nulls(1, many),
                                          pa.array([total.tolist()], pa.list_(pa.int64()))], names)
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, INDEX)


class Block:
    """Documents with their lists inverted: for each term the documents that hold it, and what each adds per weight."""

    def __init__(self, ids, n, sizes, terms, counts, n_terms: int, all_docs: int, all_terms: int):
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        m = 10 + (90 * n * all_docs) // all_terms
        self.ids, self.docs, tf = ids, doc[order], counts[order].astype(np.int64)
        self.impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs])
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.highest = np.zeros(n_terms, dtype=np.int64)
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            self.highest[filled] = np.maximum.reduceat(self.impacts, self.starts[filled])

    def search(self, item: Item, k: int, before: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (positions) and scores of those that may be among the ``k`` best, given the best scores ``before``.
        ``sums`` has a zero for every document, and is left so."""
        most = item.weights * self.highest[item.terms]
        rest = np.cumsum(most[::-1])[::-1]
        kth = int(before.min()) if len(before) >= k else 0
        held, met = None, [np.zeros(0, dtype=np.int64)]
        for j, (t, w) in enumerate(zip(item.terms, item.weights)):
            if held is None and j and rest[0] - rest[j] > rest[j]:  # partial scores may exceed what is left
                now = sums[np.unique(np.concatenate(met))]
                best = np.concatenate([now, before])
                if len(best) >= k:
                    kth = max(kth, int(np.partition(best, len(best) - k)[len(best) - k]))
            if held is None and rest[j] < kth:
                held = np.unique(np.concatenate(met))
            docs, impacts = self.docs[self.starts[t] : self.starts[t + 1]], self.impacts[self.starts[t] : self.starts[t + 1]]
            if not len(docs):
                continue
            if held is None:
                sums[docs] += w * impacts
                met.append(docs)
            elif len(held):
                at = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
                hit = docs[at] == held
                sums[held[hit]] += w * impacts[at[hit]]
        held = np.unique(np.concatenate(met)) if held is None else held
        scores = sums[held]
        sums[held] = 0
        keep = (scores > 0) & (scores >= kth)
        return held[keep], scores[keep]


def search_blocks(index: DataFrame, items: list[Item], n_terms: int, all_docs: int, all_terms: int, k: int) -> DataFrame:
    """(item, id, score, rank): every item's ``k`` best documents."""
    def run(batches):
        from pyspark import TaskContext
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none)] * len(items)

        def take(held):
            flat = pa.Table.from_batches(held).combine_chunks()
            ids, n = flat.column(0).to_numpy(), flat.column(1).to_numpy()
            lists, counts = flat.column(2).combine_chunks(), flat.column(3).combine_chunks()
            block = Block(ids, n, lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), counts.flatten().to_numpy(), n_terms, all_docs, all_terms)
            sums = np.zeros(len(ids), dtype=np.int64)
            for j, x in enumerate(items):
                old_ids, old = best[j]
                at, scores = block.search(x, k, old, sums)
                if len(at):
                    all_ids, all_scores = np.concatenate([old_ids, ids[at]]), np.concatenate([old, scores])
                    top = np.lexsort((all_ids, -all_scores))[:k]
                    best[j] = all_ids[top], all_scores[top]
        held, rows = [], 0
        for batch in slices(batches, BLOCK):
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                take(held)
                held, rows = [], 0
        if rows:
            take(held)
        names = [x.item for x, (found, _) in zip(items, best) for _ in range(len(found))]
        part = TaskContext.get().partitionId() % MERGE
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([none, *(i for i, _ in best)])),
                                          pa.array(np.concatenate([none, *(s for _, s in best)])), pa.array(np.full(len(names), part, dtype=np.int32))],
                                         ["item", "id", "score", "part"])
    rows = index.where("totals is null").select("id", "n", "terms", "counts")
    found = rows.mapInArrow(run, "item long, id long, score long, part int")
    order = [F.col("score").desc(), F.col("id")]
    some = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return (found.withColumn("rank", some).where(F.col("rank") <= k).select("item", "id", "score")
            .withColumn("rank", last).where(F.col("rank") <= k))


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(``item_key``, rank from 1, ``key``, score): each item's ``k`` documents of highest score above 0."""
    out = None
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64(F.col(item_key).cast("long")), F.lit(blocks)) == b) if blocks > 1 else items
        wanted = item_terms(some, item_key, item_text).collect()  # about ITEM_BYTES of text
        number: dict[bytes, int] = {}
        for r in wanted:
            for t in r["terms"]:
                number.setdefault(bytes(t), len(number))
        index = written(build_index(docs, key, text, number), "lexical-index")
        sums = index.where("totals is not null").select(F.posexplode("totals").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        total = {r["at"]: r["n"] for r in sums.collect()}  # a row a term of the items, and two
        all_docs, all_terms = total.get(0, 0), total.get(1, 0)
        weight = lambda t: math.floor(1000 * math.log((2 * all_docs + 2) / (2 * total[t + 2] + 1)))
        searched = []
        for r in wanted:
            terms = sorted((t for t in (number[bytes(x)] for x in r["terms"]) if total.get(t + 2, 0)), key=lambda t: (total[t + 2], t))
            searched.append(Item(r["item"], np.array(terms, dtype=np.int64), np.array([weight(t) for t in terms], dtype=np.int64)))
        found = search_blocks(index, searched, len(number), all_docs, max(all_terms, 1), k)
        found = found.select(F.col("item").alias(item_key), "rank", F.col("id").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    return out
