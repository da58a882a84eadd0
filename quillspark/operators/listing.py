"""Listing queries over dated records (E1 of the survey).

``listing`` applies, in order: base type selection, conjunctive equality
filters, term membership (semi-joins), featured / past / future exclusion,
total count, date sort, offset and limit, and the "more exist" flag.
Everything stays one lazy plan: the total is a scalar subquery, so no
global window pulls the rows into one task, and sort + limit becomes a
TakeOrderedAndProject (each task keeps only offset+count rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.nulls import is_not


@dataclass
class ListingSpec:
    """Query parameters of one listing (not data)."""

    page_type: str | None = None
    filters: dict = field(default_factory=dict)      # column -> required value
    terms: dict = field(default_factory=dict)        # array column -> required term
    exclude_featured: bool = False
    exclude_past: bool = False
    exclude_future: bool = False
    order: str = "desc"
    offset: int = 0
    count: int | None = None                         # None -> 5, 0 -> all

    @property
    def limit(self) -> int | None:
        """Items shown at most; None shows everything."""
        if self.count == 0:
            return None
        return 5 if self.count is None else int(self.count)


def as_of_col(as_of) -> Column:
    """``now`` as a parameter, so results are reproducible."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp_ntz")


def select_items(df: DataFrame, spec: ListingSpec, *, date_col: str, type_col: str | None = None,
                 featured_col: str | None = None, term_sets: dict | None = None,
                 as_of=None) -> DataFrame:
    """The filtered item set of a listing, before counting and sorting.

    ``term_sets`` maps a term column to a (key, term) DataFrame: membership is
    then a left-semi join (an inverted index lookup) instead of an array test.
    """
    q = df
    if spec.page_type is not None and type_col:
        q = q.where(F.col(type_col) == F.lit(spec.page_type))
    for c, v in spec.filters.items():
        q = q.where(F.col(c) == F.lit(v))
    for c, term in spec.terms.items():
        if term_sets and c in term_sets:
            key, index = term_sets[c]
            members = index.where(F.col("term") == F.lit(term)).select(key).distinct()
            q = q.join(members, on=key, how="left_semi")
        else:
            q = q.where(F.array_contains(F.col(c), F.lit(term)))
    if spec.exclude_featured and featured_col:
        q = q.where(is_not(featured_col, True))
    now = as_of_col(as_of)
    if spec.exclude_past:
        q = q.where(F.col(date_col) >= now)
    if spec.exclude_future:
        q = q.where(F.col(date_col) < now)
    return q


def listing(df: DataFrame, spec: ListingSpec, *, date_col: str, id_col: str,
            type_col: str | None = None, featured_col: str | None = None,
            term_sets: dict | None = None, as_of=None) -> DataFrame:
    """Run a listing; adds ``total`` (items before the limit) and ``more``."""
    items = select_items(df, spec, date_col=date_col, type_col=type_col,
                         featured_col=featured_col, term_sets=term_sets, as_of=as_of)
    total = items.select(F.count(F.lit(1))).scalar()
    desc = spec.order.lower().startswith("d")
    keys = [F.col(date_col).desc_nulls_last(), F.col(id_col).desc()] if desc else \
        [F.col(date_col).asc_nulls_last(), F.col(id_col).asc()]
    q = items.orderBy(*keys)
    if spec.offset > 0:
        q = q.offset(spec.offset)
    if spec.limit is None:
        return q.withColumns({"total": total, "more": F.lit(False)})
    return (q.limit(spec.limit).withColumn("total", total)
             .withColumn("more", F.col("total") > F.lit(spec.limit)))
