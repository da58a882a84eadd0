"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import scratch_path

#: Most bytes that a side may have, by its counted rows, to be sent to every executor.
BROADCAST_BYTES = 8 << 20


def by_value(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value, so that executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def slices(batches, rows: int = 256):
    """Arrow batches cut to ``rows`` rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read again: later uses read the files, and
    a lost executor costs a reread, not a recomputation."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and, in the struct ``row``, all others: nothing that an operator adds can clash with those."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    return docs.select(*keep, F.struct(*rest, F.lit(None).cast("int").alias("__none")).alias("row"))


def unpacked(docs: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The ``columns`` in their order: those of ``new`` as given there, the others from the struct."""
    return docs.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` (counted) of ``row_bytes`` (an upper bound) fit the limit; otherwise
    as it is, for the planner's shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def hash_sample(df: DataFrame, key: str, rows: int, total: int, salt: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of ``key``: all rows if there are fewer. For fitting only."""
    if total <= rows:
        return df
    share = math.ceil((1 << 40) * rows / total)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 40)) < share)


#: Bytes of ASCII words: digits and letters, A-Z lower-cased, and all bytes of other characters; the rest become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ascii_words(text: bytes, piece: int = 1 << 20):
    """The words of a UTF-8 text, as lists: maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z
    lower-cased. A list holds the words of about ``piece`` bytes, so a long text is never held as words at once."""
    folded, at = text.translate(_WORD_BYTES), 0
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def text_of(col: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside the body it is a lambda variable, not a copied expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, whole, from_base, start: int, chunk: int) -> Column:
    """Running results of an array of longs, the element itself included: results of chunks first, then within each chunk,
    so that an array of n costs n * (chunk + n / chunk) small steps and not n * n. ``whole`` is the result of an array,
    ``from_base`` puts two results together, ``start`` is that of nothing."""
    run = lambda c, base: F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: from_base(base, whole(F.slice(c, F.lit(1), i))))

    def by_chunks(v):
        index = F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(chunk)).cast("int") - 1)
        before = lambda found, k: F.when(k > 0, whole(F.slice(found, F.lit(1), k))).otherwise(F.lit(start).cast("long"))
        return let(F.transform(index, lambda k: F.slice(v, k * chunk + 1, F.lit(chunk))), lambda chunks: let(
            F.transform(chunks, whole), lambda found: F.flatten(F.zip_with(
                chunks, F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda k: before(found, k)), run))))
    return let(values, lambda v: F.when(F.size(v) > 0, by_chunks(v)).otherwise(F.array().cast("array<bigint>")))


def prefix_sums(values: Column, chunk: int = 256) -> Column:
    """Running sums."""
    return _running(values, lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x), lambda a, b: a + b, 0, chunk)


def prefix_maxima(values: Column, chunk: int = 256) -> Column:
    """Running maxima of longs from 0 up."""
    return _running(values, F.array_max, F.greatest, 0, chunk)
