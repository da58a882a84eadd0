"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is logistic in the words it holds (a word counts by itself if it is known, else by the longest
known prefix of 4 to 8 letters, so that one stem with many endings is learnt too); a document's is their noisy-or with a leak,
``1 - (1 - leak) * prod(1 - p)``. Only documents carry labels. The leak takes up labels that no sentence explains, once
a document, so that long clean documents do not add up to toxic ones; sentences without any known word have the
probability of the bias, at most ``sigmoid(BIAS)``. After training, the sentences of 0.5 or more locate the offence.

Training has two steps. Words and prefixes that go with the label are found by grouped counts over the labelled documents (all of
a G-squared of ``SIGNIFICANT`` or more). Then weights and leak are fitted by gradient ascent on the labels' likelihood, over
the sentences that hold such words; sentences of a document that hold the same ones count together. It uses at most about
``ROWS`` labelled documents, chosen by a hash of their ids; an id with several labels is toxic if one of them says so, and
of rows that share a labelled id one text is learnt from (that of the least hash). Scoring covers every whole text.

A null or empty text has no sentences and scores the leak; without labels, or with labels of one kind only, there are no
words and the leak is the share of toxic labels (0 without any). Repeated rows score alike; columns of the output's
names are replaced. Very long texts are cut to sentences whole. Words of equal strength come by name. An empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import by_value, hash_sample, slices, written

by_value(__name__)

ROWS, SIGNIFICANT, LEAST = 8_000, 18.0, 3
PREFIX = (4, 8)
CACHE = 1 << 19
BIAS, STEPS, RATE, RIDGE, OFFENDS = -12.0, 200, 0.05, 0.02, 0.5
SENTENCE, WORD = r"[^.!?\n]*[^\s.!?][^.!?\n]*[.!?]*", r"[^\W\d_]+"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    bias: float = BIAS
    leak: float = 0.0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def terms(word: str) -> list[str]:
    """What a word may be known by: itself, then its prefixes, longest first (marked by a star)."""
    return [word, *(word[:k] + "*" for k in range(min(PREFIX[1], len(word) - 1), PREFIX[0] - 1, -1))]


def known_by(word: str, known: dict, cache: dict) -> str | None:
    if word not in cache:
        if len(cache) > CACHE:
            cache.clear()
        cache[word] = next((t for t in terms(word) if t in known), None)
    return cache[word]


def _rows(schema: pa.Schema, make):
    """A mapInArrow function: the rows that the function from ``make()`` gives for each (text, label)."""

    def run(batches):
        f = make()
        for batch in slices(batches, 64):
            rows = [r for text, label in zip(*(c.to_pylist() for c in batch.columns)) for r in f(text or "", label)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def fit(bags: list[tuple[int, int, list[list[int]], list[int]]], start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak from bags (label, sentences, word numbers of the different sentences that have some, and how often
    each of these occurs)."""
    y = np.array([b[0] for b in bags], dtype=np.float64)
    sentences = [(k, s) for k, b in enumerate(bags) for s in b[2]]
    times = np.array([n for b in bags for n in b[3]], dtype=np.float64)
    bag = np.array([k for k, _ in sentences], dtype=np.int64)
    at = np.repeat(np.arange(len(sentences)), [len(s) for _, s in sentences])
    word = np.array([w for _, s in sentences for w in s], dtype=np.int64)
    plain = np.array([b[1] - sum(b[3]) for b in bags], dtype=np.float64)
    w, bias = start.copy(), BIAS
    silent = np.bincount(bag, minlength=len(bags)) == 0
    leak = float(np.clip((y[silent].sum() + 0.1) / (silent.sum() + 1), 1e-4, 0.5))
    mean, square = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        p = _sigmoid(bias + np.bincount(at, w[word], minlength=len(sentences)))
        log_clean = np.bincount(bag, times * np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags)) + plain * math.log1p(-float(_sigmoid(bias)))
        clean = np.exp(log_clean) * (1 - leak)
        pull = np.where(y > 0, clean / np.maximum(1 - clean, 1e-9), -1.0)  # d log likelihood / d (-log clean)
        grad = np.bincount(word, (pull[bag] * p * times)[at], minlength=len(w)) - RIDGE * (w - start)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w += RATE * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-6)
    return w, bias, leak


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS) -> Model:
    """``labels`` has (key, label of 0 or 1); rows with a null in either, and keys that ``docs`` lacks, are passed over."""
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y")).where("__key is not null and __y in (0, 1)")
    known = written(known.groupBy("__key").agg(F.max("__y").alias("__y")), "labels")
    known = hash_sample(known, "__key", rows, known.count(), 5)  # about ``rows`` different keys: a row of a key and an int each
    sample = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(known), "__key")
    sample = sample.groupBy("__key", "__y").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).select("__text", "__y")
    sample = written(sample, "labelled")  # read three times below

    def words():
        return lambda t, y: ((x, y) for x in {x for w in set(re.findall(WORD, t.lower())) for x in terms(w)})
    totals = {r["__y"]: r["n"] for r in sample.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model({}, leak=float(pos > 0))
    a, b = F.col("a"), F.col("n") - F.col("a")
    part = lambda x, of, other, n: x * F.ln(F.greatest(x, F.lit(1e-9)) * n / (of * (x + other)))
    all_ = float(pos + neg)
    g2 = 2 * (part(a, pos, b, all_) + part(b, neg, a, all_) + part(pos - a, pos, neg - b, all_) + part(neg - b, neg, pos - a, all_))
    strong = (sample.mapInArrow(_rows(pa.schema([("word", pa.string()), ("y", pa.int32())]), words), "word string, y int").groupBy("word").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
              .where((F.col("n") >= LEAST) & (F.col("n") < pos + neg) & (a * neg > b * pos)).withColumn("g2", g2).where(F.col("g2") >= SIGNIFICANT)
              .orderBy(F.desc("g2"), "word").collect())  # words of the sample that occur LEAST times or more
    number = {r["word"]: k for k, r in enumerate(strong)}
    start = np.array([-BIAS + math.log((r["a"] + 0.5) / (r["n"] - r["a"] + 0.5)) for r in strong])

    def bag():
        cache: dict = {}

        def of(t, y):
            sentences = [{known_by(w, number, cache) for w in re.findall(WORD, x.lower())} - {None} for x in re.findall(SENTENCE, t)]
            found = Counter(tuple(sorted(number[w] for w in s)) for s in sentences if s)
            return [(y, len(sentences), list(found), list(found.values()))]
        return of
    kinds = pa.schema([("y", pa.int32()), ("n", pa.int32()), ("words", pa.list_(pa.list_(pa.int32()))), ("times", pa.list_(pa.int32()))])
    bags = [tuple(r) for r in sample.mapInArrow(_rows(kinds, bag), "y int, n int, words array<array<int>>, times array<int>").collect()]
    w, bias, leak = fit(bags, start)
    return Model({r["word"]: float(x) for r, x in zip(strong, w)}, bias, leak)


def score_text(text: str, model: Model, cache: dict) -> tuple[float, list[dict]]:
    """A text's probability, and its offending sentences (code point offsets, end exclusive). ``cache`` keeps what words
    are known by."""
    known, n, found = model.words, 0, []
    if all(known_by(w, known, cache) is None for w in set(re.findall(WORD, text.lower()))):
        n = len(re.findall(SENTENCE, text))
    else:
        for m in re.finditer(SENTENCE, text):
            if z := {known_by(w, known, cache) for w in re.findall(WORD, m[0].lower())} - {None}:
                found.append({"start": m.start(), "end": m.end(), "score": float(_sigmoid(model.bias + sum(known[x] for x in sorted(z))))})
            else:
                n += 1
    clean = (1 - model.leak) * (1 - float(_sigmoid(model.bias))) ** n * math.prod(1 - s["score"] for s in found)
    return 1 - clean, [s for s in found if s["score"] >= OFFENDS]


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all, if None) with ``toxicity``, 0 to 1, and ``offending``, the sentences that offend with
    their scores."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("toxicity", "offending")]
    named = docs.select(*carry, F.col(text).alias("__text")) if text not in carry else docs.select(*carry)
    at = len(carry) if text not in carry else carry.index(text)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        cache: dict = {}
        for batch in slices(batches):
            found = [score_text(t or "", model, cache) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carry)], pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], spans)],
                [*carry, "toxicity", "offending"])
    out = T.StructType([*docs.select(*carry).schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("offending", SPANS)])
    return named.mapInArrow(run, out)
