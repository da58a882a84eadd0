"""Prefixed-JSON archive parts and their manifest (SRC-02, SRC-03).

A part file is ``window.YTD.<type>.partN = [`` and its records, each in lines indented by two spaces or more, then ``]``; a record
is a one-key object around its fields. The manifest is ``window.<name> = {"dataTypes": {<type>: {"files": [{"fileName",
"globalName", "count"}]}}}`` with counts held as text.

No file is ever held whole: JSON strings hold no line breaks, so ``BORDER`` stands between two records and nowhere else, and
the text source reads a part of any size in as many splits as it has, with the border as line separator. A manifest is read the
same way, entry by entry. Parts are written row by row, one sorted task a part; their manifest has a line for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}   # keep microseconds
BORDER = ",\n  {"
PREFIX_RE = r"^\s*window\.[^=]*=\s*\[\s*"
ENTRY = "fileName string, globalName string, count string"


def write_parts(df: DataFrame, path: str, data_type: str | Column, wrapper: str, part_col: Column, order_col: str) -> DataFrame:
    """Write ``df`` as archive parts, one file per data type and part value, and return the catalog: a row a part with its
    names and count, and the number of rows that the write itself saw (``written``, by an observation)."""
    kind = F.lit(data_type) if isinstance(data_type, str) else data_type
    rec = F.to_json(F.struct(F.struct(*[F.col(c) for c in df.columns]).alias(wrapper)), JSON_OPTIONS)
    rows = df.select(kind.alias("_type"), part_col.cast("string").alias("_part"), F.col(order_col).alias("_order"), rec.alias("_json"))
    seen = Observation()
    order = Window.partitionBy("_type", "_part").orderBy("_order", "_json")
    first, last = F.row_number().over(order) == 1, F.lead(F.lit(1)).over(order).isNull()
    head = F.concat(F.lit("window.YTD."), "_type", F.lit(".part"), "_part", F.lit(" = [\n"))
    line = F.concat(F.when(first, head).otherwise(F.lit("")), F.lit("  "), "_json", F.when(last, F.lit("\n]")).otherwise(F.lit(",")))
    lines = rows.repartition("_type", "_part").select("_type", "_part", line.alias("value"))
    lines.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("_type", "_part").text(path)
    counts = rows.groupBy("_type", "_part").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("_type").alias("data_type"), F.concat(F.lit("_part="), "_part").alias("fileName"),
                         F.concat(F.lit("YTD."), "_type", F.lit(".part"), "_part").alias("globalName"), "count", F.lit(seen.get["n"]).cast("bigint").alias("written"))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, body): each record's JSON; ``name`` is the part's global name, in the first piece of a file only."""
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", BORDER).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    first = F.col("value").rlike(PREFIX_RE)
    body = F.when(first, F.regexp_replace("value", PREFIX_RE, "")).otherwise(F.concat(F.lit("{"), "value"))
    body = F.regexp_replace(body, r"\s*\]\s*;?\s*$", "")   # a record ends with a brace: only the last piece has a bracket here
    return raw.select("file", F.when(first, F.regexp_extract("value", r"^\s*window\.(\S+)\s*=", 1)).alias("name"), body.alias("body"))


def read_parts(spark: SparkSession, path: str, wrapper: str, element_ddl: str) -> DataFrame:
    """SRC-02: the unwrapped records of all parts below ``path``. A record that is no JSON object is an error."""
    records = _pieces(spark, path).where("body <> ''")
    parsed = F.from_json("body", f"struct<{wrapper}: {element_ddl}>", {**JSON_OPTIONS, "mode": "FAILFAST"})
    return records.select(parsed.alias("_r")).select(f"_r.{wrapper}.*")


def part_counts(spark: SparkSession, path: str) -> DataFrame:
    """Actual record count per part (global name taken from the prefix); the records of a part are counted in many tasks."""
    counts = _pieces(spark, path).groupBy("file").agg(F.max("name").alias("globalName"), F.count_if(F.col("body") != "").alias("actual"))
    return counts.select("globalName", "actual", F.element_at(F.split("file", "/"), -2).alias("fileName"))


def write_manifest(catalog: DataFrame, manifest_path: str) -> None:
    """Write the manifest of the ``catalog`` of ``write_parts``: a line a part, in as many files as it has tasks."""
    entry = F.struct("fileName", "globalName", F.col("count").cast("string").alias("count"))
    doc = F.to_json(F.struct(F.create_map(F.col("data_type"), F.struct(F.array(entry).alias("files"))).alias("dataTypes")))
    catalog.select(F.concat(F.lit("window.__manifest = "), doc).alias("value")).write.mode("overwrite").text(manifest_path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: one row per declared file: data type, names, declared count (0 if it is no number). Works for one document of
    all types and for a line a part alike: each entry ends with a brace, and the first of a type follows the type's name."""
    raw = spark.read.option("lineSep", "}").text(path)
    entry = F.from_json(F.concat(F.regexp_extract("value", r"(?s)\{[^{]*$", 0), F.lit("}")), ENTRY)
    kind = F.nullif(F.regexp_extract("value", r'(?s)"([^"]+)"\s*:\s*\{[^{}]*"files"\s*:\s*\[\s*\{[^{]*$', 1), F.lit(""))
    files = raw.where(F.col("value").contains('"globalName"')).select(entry.alias("f"), kind.alias("kind")).where("f.globalName is not null")
    files = files.withColumn("stem", F.regexp_replace("f.globalName", r"\.part[^.]*$", ""))
    kinds = files.where("kind is not null").groupBy("stem").agg(F.max("kind").alias("data_type"))
    return files.join(kinds, "stem", "left").select("data_type", "f.fileName", "f.globalName", F.coalesce(F.col("f.count").try_cast("bigint"), F.lit(0)).alias("declared"))


def check_manifest(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """SRC-03 assertions: declared count equals records read; files listed
    but missing are reported (actual null, ok false)."""
    j = manifest.join(counts.select("globalName", "actual"), on="globalName", how="left")
    return j.withColumn("ok", F.coalesce(F.col("declared") == F.col("actual"), F.lit(False)))


def type_assertions(checked: DataFrame) -> DataFrame:
    """SRC-03 assertions per data type: its files, entries as declared and as read, whether all files are as declared, and
    whether it is one file with one entry."""
    return checked.groupBy("data_type").agg(
        F.count(F.lit(1)).alias("files"), F.sum("declared").alias("entries"), F.coalesce(F.sum("actual"), F.lit(0)).alias("actual"), F.every("ok").alias("ok")
    ).withColumn("single", (F.col("files") == 1) & (F.col("entries") == 1))


def single_entry(parts: DataFrame, manifest: DataFrame, data_type: str) -> DataFrame:
    """SRC-03: the one record of a data type that must have one file with one entry (an account, say); anything else is
    an error when the record is read."""
    n = manifest.where(F.col("data_type") == data_type).agg(F.count(F.lit(1)).alias("files"), F.sum("declared").alias("entries"))
    files, entries = n.select("files").scalar(), n.select("entries").scalar()
    wrong = F.raise_error(F.lit(f"{data_type}: one file with one entry is expected"))
    return parts.where(F.when((files == 1) & (entries == 1), F.lit(True)).otherwise(wrong.cast("boolean")))
