"""Array, JSON and map helpers (FN-A*, FN-J1, FN-K1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside the body it is a lambda variable, not a copied expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, whole, put_together, start: int, chunk: int) -> Column:
    """Running results of an array of longs, the element itself included: results of chunks first, then within each chunk,
    so that an array of n costs n * (chunk + n / chunk) small steps and not n * n. ``whole`` is the result of an array,
    ``put_together`` that of two results, ``start`` that of nothing."""
    run = lambda c, base: F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: put_together(base, whole(F.slice(c, F.lit(1), i))))

    def by_chunks(v):
        index = F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(chunk)).cast("int") - 1)
        before = lambda found, k: F.when(k > 0, whole(F.slice(found, F.lit(1), k))).otherwise(F.lit(start).cast("long"))
        return let(F.transform(index, lambda k: F.slice(v, k * chunk + 1, F.lit(chunk))), lambda chunks: let(
            F.transform(chunks, whole), lambda found: F.flatten(F.zip_with(
                chunks, F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda k: before(found, k)), run))))
    return let(values, lambda v: F.when(F.size(v) > 0, by_chunks(v)).when(F.size(v) == 0, F.array().cast("array<bigint>")))


def running_sums(values: Column, chunk: int = 256) -> Column:
    """Running sums of an array of longs."""
    return _running(values, lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x), lambda a, b: a + b, 0, chunk)


def running_maxima(values: Column, chunk: int = 256) -> Column:
    """Running maxima of an array of longs from 0 up."""
    return _running(values, F.array_max, F.greatest, 0, chunk)


def merge_spans(spans) -> Column:
    """FN-A2: merge overlapping ``struct<start,end>`` spans (inclusive ends, from 0 up).

    Sorted by start, a span begins an island if it starts after the furthest end so far (a running maximum); an island
    ends at the furthest end before the next one begins. Islands are found by filters over the array, so nothing is
    appended span by span. (The source takes the newer end even when shorter; we keep the union.)
    """
    def islands(srt, reach):
        begins = F.filter(F.sequence(F.lit(0), F.size(srt) - 1), lambda i: (i == 0) | (F.get(srt, i)["start"] > F.get(reach, i - 1)))
        return let(begins, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(srt, i)["start"].cast("int").alias("start"),
            F.get(reach, F.coalesce(F.get(at, k + 1), F.size(srt)) - 1).cast("int").alias("end"))))
    ends = lambda srt: running_maxima(F.transform(srt, lambda x: x["end"].cast("long")))
    return let(F.array_sort(_c(spans)), lambda srt: F.when(F.size(srt) > 0, let(ends(srt), lambda reach: islands(srt, reach)))
               .when(F.size(srt) == 0, F.array().cast("array<struct<start:int,end:int>>")))


def hit_spans(text, term: str) -> Column:
    """Spans ``[start, end]`` (0-based, inclusive) of every case-insensitive
    occurrence of ``term`` in the whole ``text``: the text is split at the
    term, and running sums of the pieces' lengths and the terms between them
    give the places (after the last piece is the end of the text, not a hit)."""
    tl = len(term)
    pieces = F.split(_c(text), "(?i)" + _escape(term), -1)
    steps = let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: (F.length(x) + tl).cast("long")))
    return F.transform(running_sums(steps), lambda e: F.struct((e - tl).cast("int").alias("start"), (e - 1).cast("int").alias("end")))


def _escape(term: str) -> str:
    import re
    return re.escape(term)


def filter_map(arr, keep, f) -> Column:
    """FN-A3: keep the elements that pass ``keep``, then map them with ``f``."""
    return F.transform(F.filter(_c(arr), keep), f)


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0), lambda a, b: a + b)


def parse_props(x, schema: str = "k int") -> Column:
    """FN-J1: parse a JSON object column."""
    return F.from_json(_c(x), schema)


def with_defaults(m, defaults: dict) -> Column:
    """FN-K1: merge a map over defaults (the map's own keys win)."""
    d = F.create_map(*[F.lit(v) for kv in defaults.items() for v in kv])
    keep = F.map_filter(d, lambda k, v: ~F.map_contains_key(_c(m), k))
    return F.map_concat(keep, _c(m))
