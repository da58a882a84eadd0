"""Search (SEA-*): corpus build, weighted fuzzy search, snippets, hit
highlighting, result counts and conversation search. Related items (SEA-06)
are in ``related``, the stored index that answers queries without reading
texts in ``search_index``.

The functions here score each row on its own whole text with JVM-side
higher-order functions: one scan with no shuffle, for a corpus searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import hit_spans, merge_spans
from quillspark.functions.boolquery import compile_query
from quillspark.functions.text import ACCENTED, FOLDED, auto_summary, fold_accents, strip_html
from quillspark.operators.filters import visible
from quillspark.operators.joins import resolve_members
from quillspark.session import materialize

# Field weights, threshold and length limits of the site search.
FIELD_WEIGHTS = {"title": 0.99, "summary": 0.6, "authors": 0.5, "content": 0.2,
                 "tags": 0.5, "categories": 0.5}
THRESHOLD = 0.3
MIN_LENGTH = 2
SNIPPET_CHARS = 60
SUMMARY_SECTIONS = ("publication", "talk")
TOKEN_SPLIT = r"[\s.,;:!?\"()\[\]]+"


def build_corpus(pages: DataFrame, authors_dim: DataFrame | None = None) -> DataFrame:
    """SEA-01: one row per visible page with the 17 index fields.

    ``pages`` needs: object_id, date, publishdate, lastmod, expirydate, lang, title, summary, abstract,
    content (may hold HTML), authors (array), kind, type, section, tags,
    categories, draft, private. Authors are resolved against ``authors_dim``
    (slug, name) by JN-04: distinct author lists are resolved by a join, of
    whatever size, and go back to the pages that hold them.
    """
    p = pages.where(visible(F.col("draft"), F.col("private")))
    authors = F.col("authors")
    if authors_dim is not None:
        p = resolve_members(p.withColumn("_slugs", F.col("authors")), "_slugs", authors_dim, "slug", "name", "_names")
        authors = F.when(F.col("section") == "authors", F.col("authors")).otherwise(F.col("_names"))
    # the page of an author is the author's profile, whatever file its text comes from
    link = F.when(F.col("section") == "authors", F.concat(F.lit("/authors/"), F.get("authors", F.lit(0)), F.lit("/"))) \
            .otherwise(F.col("relpermalink"))
    plain = strip_html(F.col("content"))
    desc = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.nullif(F.col("abstract"), F.lit("")),
                      auto_summary(plain))
    return p.select(
        F.col("object_id").alias("objectID"), F.unix_timestamp(F.col("date").cast("timestamp")).alias("date"),
        F.col("publishdate").cast("timestamp_ntz").alias("publishdate"), F.unix_timestamp(F.col("lastmod").cast("timestamp")).alias("lastmod"),
        F.unix_timestamp(F.col("expirydate").cast("timestamp")).alias("expirydate"),
        "lang", F.concat(F.lit("https://example.org"), link).alias("permalink"), link.alias("relpermalink"),
        "title", strip_html(desc).alias("summary"), plain.alias("content"), authors.alias("authors"), "kind",
        "type", "section", "tags", "categories")


def tokens(x: Column) -> Column:
    """Distinct lower-cased, accent-folded tokens of the whole text (the
    search is diacritic-insensitive)."""
    return F.array_distinct(F.filter(F.split(fold_accents(F.lower(x)), TOKEN_SPLIT), lambda t: t != ""))


def query_terms(query: str) -> list[str]:
    fold = str.maketrans(ACCENTED, FOLDED)
    query = query.strip().lower()
    return [t.translate(fold) for t in query.split()] if len(query) >= MIN_LENGTH else []


def similarity(token: Column, q: str, threshold: float = THRESHOLD) -> Column:
    """``1 - lev/maxlen`` of a token and ``q``, or 0 when below ``1 - threshold``. The distance is computed with an
    upper bound (tokens whose distance must exceed it cost O(bound) and give -1)."""
    ql = len(q)
    max_d = int(threshold * max(ql, 1) / (1 - threshold)) + 1
    lev = F.levenshtein(token, F.lit(q), max_d)
    r = F.lit(1.0) - lev / F.greatest(F.length(token), F.lit(ql))
    return F.when((lev >= 0) & (r >= 1 - threshold), r).otherwise(F.lit(0.0))


def _ratio_col(toks: Column, q: str, threshold: float) -> Column:
    """Best similarity of any token to ``q`` (those below the threshold count 0: the maximum is the thresholded one)."""
    return F.coalesce(F.array_max(F.transform(toks, lambda t: similarity(t, q, threshold))), F.lit(0.0))


def fuzzy_score(fields: dict[str, Column], query: str, weights: dict[str, float] = FIELD_WEIGHTS,
                threshold: float = THRESHOLD, tokenized: bool = False) -> Column:
    """SEA-02 score: per field, mean over query terms of the best token
    similarity; fields combined by weight and normalised to 0..1.
    With ``tokenized`` the field columns already hold token arrays."""
    terms = query_terms(query)
    total_w = sum(weights[f] for f in fields)
    acc = F.lit(0.0)
    for name, col in fields.items():
        toks = col if tokenized else tokens(col)
        per = F.lit(0.0)
        for t in terms:
            per = per + _ratio_col(toks, t, threshold)
        acc = acc + F.lit(weights[name]) * (per / F.lit(float(max(len(terms), 1))))
    return acc / F.lit(total_w)


def tokenize_fields(df: DataFrame, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    """One projection holding each field's token array (computed once)."""
    return df.select(*keep, *[tokens(c).alias(f"_tok_{n}") for n, c in fields.items()])


def scored(corpus: DataFrame, fields: dict[str, Column], query: str, keep: list[str]) -> DataFrame:
    """Every row of ``corpus`` with its fuzzy ``score``."""
    tok = tokenize_fields(corpus, fields, keep)
    cols = {n: F.col(f"_tok_{n}") for n in fields}
    return tok.select(*keep, fuzzy_score(cols, query, tokenized=True).alias("score"))


def hits(corpus: DataFrame, fields: dict[str, Column], query: str, keep: list[str]) -> DataFrame:
    """Rows with a positive score, unordered, written once to the shared
    checkpoint folder. Unfolding a list of one score or none drops the others:
    unlike a filter, it cannot be copied below the projection, so the score
    is computed exactly once per row."""
    sc = scored(corpus, fields, query, keep)
    one = F.filter(F.array("score"), lambda x: x > 0)
    return materialize(sc.select(*keep, F.explode(one).alias("score")), "hits")


def search(corpus: DataFrame, fields: dict[str, Column], query: str, id_col: str, k: int = 10,
           keep: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """SEA-02: the ``k`` best rows with a positive score (ties by id).
    Sort + limit plans as a per-task top-k merged at the end; the positive
    filter is applied after the limit (positive scores sort first), which
    keeps the scoring expression from being duplicated into a pushed-down
    filter."""
    sc = scored(corpus, fields, query, keep or [id_col])
    if digits is not None:
        sc = sc.withColumn("score", F.round("score", digits))
    top = sc.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)
    return top.where(F.col("score") > 0)


def snippet(content: Column, summary: Column, section: Column, query: str,
            width: int = SNIPPET_CHARS) -> Column:
    """SEA-03: ``width`` characters either side of the first hit, else the
    summary; publication and talk sections search their summary."""
    text = F.when(section.isin(*SUMMARY_SECTIONS), summary).otherwise(content)
    pos = F.instr(F.lower(text), query.lower())         # 1-based, 0 = none
    idx = pos - 1
    start = F.greatest(idx - width, F.lit(0))
    end = F.least(idx + len(query) - 1 + width, F.length(text))
    return F.when(pos > 0, F.substring(text, start + 1, end - start)).otherwise(summary)


def highlight(text: Column, term: str) -> tuple[Column, Column]:
    """SEA-04: merged hit spans and the text with hits marked."""
    import re
    spans = merge_spans(hit_spans(text, term))
    marked = F.regexp_replace(text, "(?i)(" + re.escape(term) + ")", "<mark>$1</mark>")
    return spans, marked


def with_result_count(results: DataFrame, type_col: str, labels: DataFrame, out_label: str) -> DataFrame:
    """SEA-05: total hits and a localised type label. The
    hits are expected to be materialized (see ``hits``), so the corpus is
    scanned and scored a single time for both the rows and their count."""
    n = results.select(F.count(F.lit(1))).scalar()
    lab = labels.withColumnRenamed(labels.columns[0], type_col).withColumnRenamed(labels.columns[1], "_lab")
    return (results.join(lab, on=type_col, how="left")
                   .withColumn(out_label, F.coalesce("_lab", F.col(type_col))).drop("_lab")
                   .withColumn("n_results", n))


def conversation_search(messages: DataFrame, conv: str, order: str, text: str, query: str) -> DataFrame:
    """SEA-07: conversations with at least one matching message, with the
    last matching message and the number of matches. One aggregation,
    partial per task; no join back needed."""
    m = messages.withColumn("_hit", compile_query(text, query))
    return (m.where("_hit").groupBy(conv)
             .agg(F.count(F.lit(1)).alias("n_matches"), F.max(order).alias("last_match"),
                  F.max_by(F.col(text), F.col(order)).alias("last_text")))
