"""A training-data pipeline over ``documents``: each stage's rows are written as Parquet and read as the next one's.

Toxic documents go; of each group of near-duplicates one document stays; secrets are blotted out of the texts; sources
are mixed to target weights; what is left is encoded. All stages but the last return the columns of ``documents``.
Rows with null, empty or very long texts pass through like others (a null text stays null until it is encoded as the
empty text); an empty table gives no rows. Columns that a stage does not work on are carried in one struct beside those it
does, up to the last stage, so they come through unchanged whatever their names. Rows that repeat are judged alike; of rows
that are near-duplicates the smallest ``doc_id`` stays (of rows that share it, one).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, secret_scan, simhash, toxicity
from quillspark.llm.common import packed, read, unpacked, written
from quillspark.session import clear_scratch_but_last, scratch_count

TOXIC = 0.7
SHINGLE, DISTANCE = 4, 4
#: Mixing: weights by name (any other name 1), share of the input's tokens, passes over a leaf at most, seed.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
SHARE, EPOCHS, SEED = 0.9, 1, 20
RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(packed(docs, "text"), model)
    return unpacked(scored.where(F.col("toxicity") < TOXIC), docs.columns, text=F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id."""
    return simhash.deduplicated(docs, "doc_id", "text", SHINGLE, DISTANCE)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows the new text."""
    found = secret_scan.scan(packed(docs, "text"), secret_scan.train(docs)).withColumn("blotted", secret_scan.redact(F.col("text"), "spans"))
    new = {"text": F.col("blotted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.char_length("blotted").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(found, docs.columns, **new)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes."""
    tokens = mixing.whitespace_tokens(F.col("text"))
    return mixing.mix(docs, mixing.domain_of(F.col("source")), tokens, WEIGHTS, SHARE, EPOCHS, SEED).select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    vocabulary = bpe.broadcast_vocabulary(spark, public_tokenizers.path(RANKS))
    ids = bpe.encode(docs, "text", vocabulary, public_tokenizers.PATTERN, carry=["doc_id", "lang", "source"])
    back = bpe.decode(ids, "ids", vocabulary)
    return back.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", blot_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: SQL cannot express trained models or byte-pair merges; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Once a stage's rows are written, its input and the tables it used are removed."""
    docs, start = read(spark, sf_dir, "documents"), scratch_count()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear_scratch_but_last(spark, start)
    return STAGES[-1][1](spark, docs, sf_dir)
