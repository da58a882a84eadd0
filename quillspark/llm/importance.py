"""Importance resampling towards a target distribution, by bit-sliced aggregation.

A document's features are its runs of 1 to ``runs`` consecutive words, counted in ``buckets`` hash buckets. The counts are
kept as bit planes: plane p has the bit of a bucket set if bit p of the bucket's count is set, so a document of counts up to
15 has four planes of ``buckets`` bits, whatever its length. A bucket's gain is the log of the ratio of its shares in target
and corpus, as a whole number; the gains' absolute values are bit planes too, one set for the positive and one for the
negative ones. The gains of a document's features then add up exactly, by AND, popcount and powers of two:

    weight = sum over p, q of 2^(p + q) * (popcount(counts_p AND positive_q) - popcount(counts_p AND negative_q))

The score adds Gumbel noise seeded by the document's id, and the highest scores are drawn: a sample without replacement whose
chances follow exp(weight / 1000).

Every text is read once: planes and each task's bucket totals are written, and weights come from the planes. Totals of all
documents and of all target texts make the gains; only the ``buckets`` sums of each come to the driver. The drawn documents
are numbered by a range-partitioned sort of narrow rows, so that no task holds all of them.

Null and empty texts have no feature, weight 0 and are not drawn (they have fewer than ``least`` words). Very long texts are
cut to words piece by piece. Equal scores go to smaller ids; rows that repeat an id are documents of their own, drawn and
ranked each, in any order among themselves. A null id is seeded like an empty one and comes after others of its score. An
empty corpus gives no rows, an empty target gains that only tell rare from frequent. Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_words, by_value, slices, written
from quillspark.operators.windows import row_number_scaled

by_value(__name__)

SLICE = 256
#: Words whose bucket a worker remembers; all are forgotten when there are more.
CACHE = 1 << 18
PLANES = "id long, row long, n_words long, n_features long, planes binary, totals array<long>"


class _Buckets(dict):
    """Bucket of a feature, by the CRC-32 of its bytes."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % self.buckets
        return b


def bucket_counts(text: bytes, bucket: _Buckets, runs: int) -> tuple[int, np.ndarray]:
    """Number of words, and how often each bucket occurs (as an array of longs)."""
    total, n, tail = np.zeros(bucket.buckets, dtype=np.int64), 0, []
    for words in ascii_words(text):
        n += len(words)
        joined = tail + words
        for r in range(1, runs + 1):  # a run that ends before the new words was counted with the piece before
            first = max(0, len(tail) - r + 1)
            features = joined[first:] if r == 1 else [b" ".join(joined[i : i + r]) for i in range(first, len(joined) - r + 1)]
            at = np.fromiter(map(bucket.__getitem__, features), np.int64, len(features))
            total += np.bincount(at, minlength=bucket.buckets)
        tail = joined[len(joined) - runs + 1 :] if runs > 1 else []
    return n, total


def _width(buckets: int) -> int:
    return -(-buckets // 64)


def slice_bits(counts: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers, lowest first: rows of 64-bit words, as many as the largest number needs."""
    filled = np.flatnonzero(counts)
    values = counts[filled]
    planes = int(values.max()).bit_length() if len(filled) else 0
    bits = np.zeros((planes, _width(len(counts)) * 64), dtype=np.uint8)
    for p in range(planes):
        bits[p, filled[(values >> p) & 1 == 1]] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def count_planes(docs: DataFrame, key: str | None, text: str, buckets: int, runs: int) -> DataFrame:
    """A row per document with its planes, and one per task with the bucket totals of the task's documents (``totals``;
    null in the rows of documents). ``row`` tells documents apart that share an id. Without ``key``, totals only."""
    def run(batches):
        bucket, total, row = _Buckets(buckets), np.zeros(buckets, dtype=np.int64), TaskContext.get().partitionId() << 33
        names = ["id", "row", "n_words", "n_features", "planes", "totals"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for batch in slices(batches, SLICE):
            out = []
            for t in batch.column(1).to_pylist():
                n, counts = bucket_counts(t or b"", bucket, runs)
                total += counts
                out.append((row, n, int(counts.sum()), slice_bits(counts).tobytes() if key else None, None))
                row += 1
            if out and key:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds[1:]))], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None, None, None, None, None, total.tolist()], kinds)], names)
    ids = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return docs.select(ids.alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, PLANES)


def bucket_totals(planes: DataFrame, buckets: int) -> np.ndarray:
    """The sum of all tasks' totals."""
    sums = planes.where("totals is not null").select(F.posexplode("totals").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():  # a row a bucket
        total[r["b"]] = r["n"]
    return total


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of a bucket's smoothed shares in target and corpus."""
    all_t, all_s, buckets = float(target.sum()), float(corpus.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_s + buckets) / ((float(s) + 1) * (all_t + buckets))))
                     for t, s in zip(target, corpus)], dtype=np.int64)


def weights(planes: list[bytes], positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Each document's sum of gains, from its planes and the gains' planes."""
    words = positive.shape[1]
    counts = np.array([len(p) // (8 * words) for p in planes], dtype=np.int64)
    rows = np.frombuffer(b"".join(planes), dtype="<u8").reshape(int(counts.sum()), words)
    doc = np.repeat(np.arange(len(planes)), counts)
    power = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    found = np.zeros(len(rows), dtype=np.int64)
    for sign, sliced in ((1, positive), (-1, negative)):
        for q, plane in enumerate(sliced):
            found += sign * (np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64) << q)
    out = np.zeros(len(planes), dtype=np.int64)
    np.add.at(out, doc, found << power)
    return out


def weigh(planes: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, row, n_words, n_features, weight) of the documents of ``count_planes``."""
    empty = np.zeros((0, _width(len(gain))), dtype="<u8")
    positive, negative = (slice_bits(np.maximum(s * gain, 0)) if (s * gain > 0).any() else empty for s in (1, -1))

    def run(batches):
        for batch in slices(batches, SLICE):
            found = weights([p or b"" for p in batch.column(4).to_pylist()], positive, negative)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found)], ["id", "row", "n_words", "n_features", "weight"])
    docs = planes.where("totals is null").select("id", "row", "n_words", "n_features", "planes")
    return docs.mapInArrow(run, "id long, row long, n_words long, n_features long, weight long")


def noise(key: str, seed: int):
    """floor(1000 * Gumbel noise), from the first 8 hex digits of sha256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000,
             runs: int = 1, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """Every document's (``key``, n_features, weight, score, rank): of the documents with at least ``least`` words, the
    ``percent`` hundredths of highest scores are drawn and ranked from 1; others have a null rank."""
    planes = written(count_planes(docs, key, text, buckets, runs), "count-planes")
    wanted = written(count_planes(target, None, target_text, buckets, runs), "target-totals")
    gain = gains(bucket_totals(wanted, buckets), bucket_totals(planes, buckets))
    scored = written(weigh(planes, gain).withColumn("score", F.col("weight") + noise("id", seed)), "scored")
    able = F.col("n_words") >= least
    drawn = scored.where(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    ranked = row_number_scaled(scored.where(able).select("id", "n_features", "weight", "score", "row"), order, out="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("id").alias(key), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*columns).unionByName(rest.select(*columns))
