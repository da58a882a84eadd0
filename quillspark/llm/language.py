"""Language identification by nearest centroids.

A text's letters (and the marks on them), lower-cased, everything else a space, are cut to runs of one to three characters
that hold a letter in the middle; the runs are counted in ``SIZE`` hash buckets. The vector is (1 + ln count) * idf per bucket,
scaled to length 1. Each language has up to ``CENTROIDS`` centroids, found by spherical k-means over its training vectors: a
language may be written in several ways. A text gets the language of the centroid of highest cosine. It is rejected
(``rejected``, the language still named) if it is farther from that centroid, by 1 - cosine, than ``SPREADS`` standard
deviations beyond the mean of the centroid's own training vectors.

Training reads the text and label columns only. Document frequencies are counted over all labelled documents. The centroids
are fitted on about ``ROWS`` different texts of each language, chosen by a hash of the text, so that copies of one text cannot
fill the sample; each language is fitted in a task of its own. The model that is sent to executors has at most about
``MODEL_BYTES``: with very many languages each centroid keeps its heaviest coordinates only.

A null text, or one without a letter, has no language (``UNKNOWN``, score 0). So has every text if nothing is labelled. Letters
that share nothing with any centroid give the most frequent language, score 0, rejected. Equal cosines go to the smaller
language name, then to the centroid found first. Very long texts are counted whole, piece by piece. Repeated rows are
predicted alike, and counted each in training; columns of the output's names are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import by_value, slices, small_side, written

by_value(__name__)

SIZE, ROWS, CENTROIDS, ROUNDS, SPREADS = 1 << 14, 1_000, 4, 8, 4.0
MODEL_BYTES, PIECE, LEAST = 64 << 20, 1 << 20, 25
UNKNOWN = "und"
OUTPUT = ("lang_pred", "score", "rejected")
#: Odd multipliers of the hash of a run, by its length and place.
MULTIPLIERS = ((0x9E3779B1,), (0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1, 0x9E3779B9))
_FOLD: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter (or mark), 0 for anything else; made once a worker."""
    if not _FOLD:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in map(chr, range(0x110000)):
            if unicodedata.category(c)[0] in "LM":
                low = c.lower()
                table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
        _FOLD.append(table)
    return _FOLD[0]


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's runs occur in the text (as an array of longs); all zero without a letter or mark."""
    fold, shift = letters(), np.uint32(32 - (SIZE - 1).bit_length())
    total = np.zeros(SIZE, dtype=np.int64)
    for at in range(0, len(text), PIECE):
        # a character before and after the piece, so that runs over its ends are counted, each in one piece
        before, part = text[at - 1 : at] or " ", text[at : at + PIECE]
        after = text[at + PIECE : at + PIECE + 1] or " "
        codes = fold[np.frombuffer(f"{before}{part}{after}".encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        mid = codes[1:-1] != 0
        a, b, c = codes[:-2][mid], codes[1:-1][mid], codes[2:][mid]
        for run, by in zip(((b,), (a, b), (a, b, c)), MULTIPLIERS):
            h = sum(x * np.uint32(m) for x, m in zip(run, by))
            h ^= h >> np.uint32(15)
            total += np.bincount(((h * np.uint32(0x2C1B3C6D)) >> shift).astype(np.int64), minlength=SIZE)
    return total


def vector(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of a text's buckets, of length 1 together (all zero if no bucket has a weight)."""
    v = (1 + np.log(counts)) * idf[buckets]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm > 0 else v


def cluster(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means over rows of length 1, started from rows far from each other: centroids and each row's nearest.
    A centroid that loses all its rows stays where it is."""
    starts, near = [0], rows @ rows[0]
    while len(starts) < k:
        starts.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[starts[-1]])
    c = rows[starts].copy()
    for _ in range(ROUNDS):
        own = (rows @ c.T).argmax(axis=1)
        for j in range(k):
            total = rows[own == j].sum(axis=0)
            norm = np.sqrt((total * total).sum())
            if norm > 0:
                c[j] = total / norm
    return c, (rows @ c.T).argmax(axis=1)


@dataclass(frozen=True)
class Model:
    """Languages of the centroids; the centroids' weights bucket by bucket (``first`` of each bucket's, the centroids that have a
    weight there, the weights), so that what is sent grows with the weights kept and not with buckets times centroids; the
    distance up to which each accepts; the weights of buckets; and the most frequent language (null without training rows)."""
    languages: list[str]
    first: np.ndarray
    who: np.ndarray
    weights: np.ndarray
    limits: np.ndarray
    idf: np.ndarray
    usual: str | None

    def cosines(self, buckets: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Cosine of a vector of length 1 with every centroid."""
        n = self.first[buckets + 1] - self.first[buckets]
        at = np.repeat(self.first[buckets] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.who[at], self.weights[at] * np.repeat(v, n), minlength=len(self.languages))

    def centroid(self, j: int) -> np.ndarray:
        at = np.flatnonzero(self.who == j)
        out = np.zeros(SIZE)
        out[np.searchsorted(self.first, at, side="right") - 1] = self.weights[at]
        return out


def predict_text(text: str | None, model: Model) -> tuple[str, float, bool]:
    """Language, cosine and rejection of a text."""
    counts = gram_counts(text or "")
    buckets = np.flatnonzero(counts)
    if model.usual is None or not len(buckets) or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    near = model.cosines(buckets, vector(buckets, counts[buckets], model.idf))
    best = int(near.argmax())
    if near[best] <= 0:
        return model.usual, 0.0, True
    return model.languages[best], float(min(near[best], 1.0)), bool(1 - near[best] > model.limits[best])


def _training_rows(labelled: DataFrame) -> DataFrame:
    """From (label, text, hash, picked): a row with the counts of each picked text, and one per task with the number of the
    task's texts (last) and how many of them have each bucket."""
    def run(batches):
        names, ints = ["label", "hash", "buckets", "counts", "totals"], pa.list_(pa.int32())
        total = np.zeros(SIZE + 1, dtype=np.int64)
        for batch in slices(batches):
            out = []
            for label, text, hashed, picked in zip(*(c.to_pylist() for c in batch.columns)):
                counts = gram_counts(text)
                buckets = np.flatnonzero(counts)
                if len(buckets):
                    total[buckets] += 1
                    total[SIZE] += 1
                    if picked:
                        out.append((label, hashed, buckets.astype(np.int32), np.minimum(counts[buckets], 2**31 - 1).astype(np.int32), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), ints, ints, pa.list_(pa.int64())))], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, ints), pa.nulls(1, ints),
                                          pa.array([total.tolist()], pa.list_(pa.int64()))], names)
    return labelled.mapInArrow(run, "label string, hash long, buckets array<int>, counts array<int>, totals array<long>")


def train(docs: DataFrame, text: str = "text", label: str = "lang", rows: int = ROWS) -> Model:
    """The model of all rows of ``docs`` with a text and a label."""
    known = docs.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where("label is not null and text is not null")
    known = known.withColumn("hash", F.xxhash64("text"))
    each = written(known.groupBy("label", "hash").agg(F.count("*").alias("n")).groupBy("label").agg(F.count("*").alias("texts"), F.sum("n").alias("n")), "languages")
    labels = each.count()
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("texts"))
    part = each.select("label", (share * float(1 << 40)).cast("long").alias("below"))
    picked = F.pmod(F.xxhash64("hash", F.lit(17)), F.lit(1 << 40)) < F.col("below")
    sample = written(_training_rows(known.join(small_side(part, labels, 256), "label").select("label", "text", "hash", picked.alias("picked"))), "language-rows")
    sums = sample.where("totals is not null").select(F.posexplode("totals").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n"))
    holds = np.zeros(SIZE + 1)
    for r in sums.collect():  # a row a bucket, and one
        holds[r["b"]] = r["n"]
    idf = np.log((holds[SIZE] + 1) / (holds[:SIZE] + 0.5)).clip(0)
    keep = max(64, min(SIZE, MODEL_BYTES // (8 * max(1, labels * CENTROIDS))))

    def fit(group):
        import pandas as pd
        group = group.sort_values("hash")
        data = np.zeros((len(group), SIZE), dtype=np.float32)
        for i, (b, c) in enumerate(zip(group["buckets"], group["counts"])):
            data[i, b] = vector(np.asarray(b), np.asarray(c), idf)
        centroids, own = cluster(data, int(np.clip(len(data) // LEAST, 1, CENTROIDS)))
        out = []
        for j, c in enumerate(centroids):
            far = 1 - data[own == j] @ c
            heavy = np.sort(np.argsort(-c, kind="stable")[:keep])
            heavy = heavy[c[heavy] > 0]
            limit = float(far.mean() + SPREADS * far.std()) if len(far) else 0.0
            out.append((group["label"].iloc[0], j, heavy.tolist(), c[heavy].tolist(), limit))
        return pd.DataFrame(out, columns=["label", "number", "buckets", "weights", "far"])
    texts = sample.where("totals is null").groupBy("label", "hash").agg(F.first("buckets").alias("buckets"), F.first("counts").alias("counts"))
    fitted = texts.groupBy("label").applyInPandas(fit, "label string, number int, buckets array<int>, weights array<float>, far double")
    found = sorted(fitted.collect(), key=lambda r: (r["label"], r["number"]))  # CENTROIDS rows a language, MODEL_BYTES together
    sizes = [len(r["buckets"]) for r in found]
    bucket = np.concatenate([np.zeros(0, dtype=np.int64), *(r["buckets"] for r in found)]).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(SIZE + 1))
    who = np.repeat(np.arange(len(found), dtype=np.int32), sizes)[order]
    weights = np.concatenate([np.zeros(0), *(r["weights"] for r in found)]).astype(np.float32)[order]
    usual = each.orderBy(F.desc("n"), "label").first()
    return Model([r["label"] for r in found], first, who, weights, np.array([r["far"] for r in found]), idf, usual["label"] if usual and found else None)


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all, if None) with ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUT]
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            found = [predict_text(t, model) for t in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array([x for x, _, _ in found], pa.string()),
                                              pa.array([x for _, x, _ in found], pa.float64()), pa.array([x for _, _, x in found], pa.bool_())], [*carry, *OUTPUT])
    fields = [T.StructField(c, docs.schema[c].dataType) for c in carry]
    out = T.StructType([*fields, T.StructField(OUTPUT[0], T.StringType()), T.StructField(OUTPUT[1], T.DoubleType()), T.StructField(OUTPUT[2], T.BooleanType())])
    return named.mapInArrow(run, out)
