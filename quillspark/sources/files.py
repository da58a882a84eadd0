"""Plain file sources and sinks: CSV (SRC-01, SNK-01), regex file exclusion
(SRC-06), split output (SNK-04)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import scratch_path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-01: comma-separated with a header row; the schema is explicit
    (never inferred, which would cost a full extra pass)."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-01: header row, no row names, one folder of part files."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_excluding(spark: SparkSession, path: str, patterns: list[str], fmt: str = "parquet") -> DataFrame:
    """SRC-06: read a folder, skipping files whose path matches any regex.
    The predicate is on the file-metadata column, so excluded files are
    pruned at planning time and never opened."""
    df = spark.read.format(fmt).load(path)
    if not patterns:
        return df
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("_metadata.file_path").rlike(p)
    return df.where(~hit)


def write_split(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> None:
    """SNK-04: one sub-folder per value of ``by``. Rows are first brought
    together by value; a rebalance splits a value's rows over several tasks
    once they exceed the advisory partition size, so a hot value is never one
    task, and a small one still makes few files."""
    df.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).format(fmt).save(path)
