"""Front-matter documents (SRC-04): ``---`` YAML or ``+++`` TOML header,
then the body. Parsing is the only per-row Python in the library; it runs
in ``mapInPandas`` over Arrow batches with a fixed output schema."""

from __future__ import annotations

import datetime as dt
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The parser runs in Python workers: ship this module's functions by value so
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT_SCHEMA = ("doc_key string, title string, date string, lang string, tags array<string>, "
                 "draft boolean, body string, format string, error string")


def split_front_matter(text: str) -> tuple[dict, str, str, str | None]:
    """Header dict, body, format (``yaml``, ``toml`` or ``none``) and what was wrong with the header, if anything."""
    import tomllib

    import yaml
    for fence, fmt in (("---", "yaml"), ("+++", "toml")):
        if text.startswith(fence + "\n"):
            end = text.find("\n" + fence + "\n", len(fence))
            if end < 0:
                continue
            head = text[len(fence) + 1:end]
            body = text[end + len(fence) + 2:]
            try:
                loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
                meta = yaml.load(head, Loader=loader) if fmt == "yaml" else tomllib.loads(head)
            except Exception as e:  # noqa: BLE001 - a broken header leaves the fields empty and says why
                return {}, body, fmt, f"{type(e).__name__}: {str(e)[:200]}"
            return (meta, body, fmt, None) if isinstance(meta, dict) else ({}, body, fmt, "the header is not a mapping")
    return {}, text, "none", None


def _as_text(v):
    if v is None:
        return None
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def _parse_batches(batches, text_col: str, key_col: str):
    for pdf in batches:
        rows = []
        for key, text in zip(pdf[key_col], pdf[text_col]):
            meta, body, fmt, error = split_front_matter(text or "")
            tags = meta.get("tags")
            rows.append({"doc_key": None if key is None else str(key), "title": _as_text(meta.get("title")),
                         "date": _as_text(meta.get("date")), "lang": _as_text(meta.get("lang")),
                         "tags": [str(t) for t in tags] if isinstance(tags, list) else None,
                         "draft": meta.get("draft") if isinstance(meta.get("draft"), bool) else None,
                         "body": body, "format": fmt, "error": error})
        yield pd.DataFrame(rows, columns=["doc_key", "title", "date", "lang", "tags", "draft", "body", "format", "error"])


def parse_documents(df: DataFrame, text_col: str = "value", key_col: str = "path") -> DataFrame:
    """Typed rows from front-matter texts (one document per row)."""
    out = df.select(F.col(key_col).cast("string").alias(key_col), F.col(text_col)).mapInPandas(
        lambda it: _parse_batches(it, text_col, key_col), OUTPUT_SCHEMA)
    return out.withColumn("date", F.col("date").try_cast("timestamp_ntz"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: every file under ``path`` is one document (``wholetext``)."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return parse_documents(raw, "value", "path")
