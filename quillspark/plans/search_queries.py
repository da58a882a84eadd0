"""SEA-*: search corpus, fuzzy search, snippets, highlights, counts,
related items and conversation search."""

import uuid

from pyspark.sql import functions as F

from quillspark.functions.text import ACCENTED, FOLDED, auto_summary
from quillspark.operators import search as S
from quillspark.operators.related import related
from quillspark.operators import search_index as SI
from quillspark.plans.registry import register
from quillspark.plans.tables import table
from quillspark.session import materialize, path_exists, scratch_path, spread

FIRST_LINE = r"^[^\n]*"
QUERY = "ouen thrre"
WS = r"'^\s+|\s+$'"


# ---- SQL mirrors of the Column builders (oracle side) ----------------------------
def sql_strip_html(x):
    s = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    s = f"regexp_replace({s}, '<[^>]*>', ' ', 'g')"
    for ent, ch in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
        s = f"replace({s}, '{ent}', '{ch}')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def sql_auto_summary(x):
    return f"array_to_string(regexp_split_to_array(regexp_replace({x}, {WS}, '', 'g'), '\\s+')[1:30], ' ')"


def sql_tokens(x):
    return (f"list_distinct(list_filter(regexp_split_to_array(translate(lower({x}), '{ACCENTED}', '{FOLDED}'), "
            f"'{S.TOKEN_SPLIT}'), "
            f"lambda t: t <> ''))")


def sql_ratio(tokens, q, threshold=S.THRESHOLD):
    ql = len(q)
    max_d = int(threshold * max(ql, 1) / (1 - threshold)) + 1
    r = f"(1.0 - levenshtein(t, '{q}') / greatest(length(t), {ql}))"
    return (f"coalesce(list_max(list_transform({tokens}, lambda t: CASE WHEN abs(length(t) - {ql}) > {max_d} "
            f"THEN 0.0 WHEN {r} >= {1 - threshold!r} THEN {r} ELSE 0.0 END)), 0.0)")


def sql_fuzzy(fields: dict, query: str):
    terms = S.query_terms(query)
    total_w = sum(S.FIELD_WEIGHTS[f] for f in fields)
    acc = "0.0"
    for name, col in fields.items():
        per = "0.0"
        for t in terms:
            per = f"({per} + {sql_ratio(sql_tokens(col), t)})"
        acc = f"({acc} + {S.FIELD_WEIGHTS[name]!r} * ({per} / {float(max(len(terms), 1))!r}))"
    return f"({acc} / {total_w!r})"


def _dates(key):
    """Dates of a page, from its id: written, published, changed, and (for some) expiring."""
    day = F.timestamp_seconds(F.col(key) * 3600).cast("timestamp_ntz")
    return [day.alias("date"), (day + F.expr("interval 1 day")).alias("publishdate"), (day + F.expr("interval 2 days")).alias("lastmod"),
            F.when(F.col(key) % 2 == 0, day + F.expr("interval 365 days")).alias("expirydate")]


# ---- corpus -------------------------------------------------------------------------
def corpus_pages(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), on="doc_id", how="left")
    docs = docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("object_id"),
        *_dates("doc_id"), "lang",
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string"), F.lit("/")).alias("relpermalink"),
        F.regexp_extract("text", FIRST_LINE, 0).alias("title"),
        F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("<b>Summary</b> of "), F.col("doc_id").cast("string"))).otherwise("").alias("summary"),
        F.when(F.col("doc_id") % 5 < 3, F.concat(F.lit("Abstract of "), F.col("doc_id").cast("string"))).otherwise("").alias("abstract"),
        F.col("text").alias("content"), F.array("source", "lang").alias("authors"),
        F.lit("page").alias("kind"), F.col("source").alias("type"),
        F.when(F.col("doc_id") % 50 == 7, "authors").otherwise("documents").alias("section"),
        F.array("lang").alias("tags"), F.array("source").alias("categories"),
        (F.col("toxic") == 1).alias("draft"), (F.col("quality") == 0).alias("private"))
    bench = table(spark, d, "benchmark").select(
        F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("object_id"),
        *_dates("item_id"), F.lit("en").alias("lang"),
        F.concat(F.lit("/bench/"), F.col("item_id").cast("string"), F.lit("/")).alias("relpermalink"),
        F.regexp_extract("text", FIRST_LINE, 0).alias("title"), F.lit("").alias("summary"),
        F.lit("").alias("abstract"), F.col("text").alias("content"), F.array().cast("array<string>").alias("authors"),
        F.lit("page").alias("kind"), F.lit("benchmark").alias("type"), F.lit("benchmark").alias("section"),
        F.array(F.lit("en")).alias("tags"), F.array().cast("array<string>").alias("categories"),
        F.lit(None).cast("boolean").alias("draft"), F.lit(None).cast("boolean").alias("private"))
    # ids of the two sources are disjoint by construction (prefixes), so the
    # union needs no de-duplication shuffle
    return docs.unionByName(bench)


def corpus(spark, d):
    dim = (table(spark, d, "nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("name")))
    return S.build_corpus(corpus_pages(spark, d), dim)


SQL_CORPUS = f"""
WITH pages AS (
  SELECT 'doc-' || CAST(d.doc_id AS VARCHAR) AS objectID, d.lang, d.text AS content,
         regexp_extract(d.text, '^[^\\n]*', 0) AS title, CASE WHEN d.doc_id % 50 = 7 THEN 'authors' ELSE 'documents' END AS section,
         [d.source, d.lang] AS authors_raw, [d.lang] AS tags, [d.source] AS categories, d.doc_id AS n, 'doc' AS stem, d.source AS type,
         CASE WHEN d.doc_id % 5 = 1 THEN 'Summary of ' || CAST(d.doc_id AS VARCHAR) WHEN d.doc_id % 5 < 3 THEN 'Abstract of ' || CAST(d.doc_id AS VARCHAR) END AS given
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE (l.toxic = 1) IS DISTINCT FROM true AND (l.quality = 0) IS DISTINCT FROM true
  UNION ALL
  SELECT 'bench-' || CAST(item_id AS VARCHAR), 'en', text, regexp_extract(text, '^[^\\n]*', 0), 'benchmark',
         CAST([] AS VARCHAR[]), ['en'], CAST([] AS VARCHAR[]), item_id, 'bench', 'benchmark', NULL FROM benchmark),
res AS (
  SELECT p.objectID, string_agg(coalesce(n.n_name, a.author), '; ' ORDER BY a.pos) AS authors
  FROM (SELECT objectID, unnest(authors_raw) AS author, unnest(range(len(authors_raw))) AS pos FROM pages) a
  JOIN pages p USING (objectID)
  LEFT JOIN nation n ON 'src' || CAST(n.n_nationkey AS VARCHAR) = a.author GROUP BY p.objectID)
SELECT p.objectID, p.lang, p.section, p.title, p.content, p.tags, p.categories, p.n, p.type,
       coalesce(p.given, {sql_strip_html(sql_auto_summary(sql_strip_html('p.content')))}) AS summary,
       {sql_strip_html('p.content')} AS plain,
       CASE WHEN p.section = 'authors' THEN array_to_string(p.authors_raw, '; ') ELSE coalesce(r.authors, '') END AS authors,
       CASE WHEN p.section = 'authors' THEN '/authors/' || p.authors_raw[1] || '/' ELSE '/' || p.stem || '/' || CAST(p.n AS VARCHAR) || '/' END AS relpermalink
FROM pages p LEFT JOIN res r USING (objectID)"""


@register("sea-01", f"""
SELECT objectID, n * 3600 AS date, CAST(to_timestamp(n * 3600 + 86400) AS TIMESTAMP) AS publishdate, n * 3600 + 172800 AS lastmod,
       CASE WHEN n % 2 = 0 THEN n * 3600 + 31536000 END AS expirydate, lang, 'https://example.org' || relpermalink AS permalink, relpermalink,
       title, summary, CAST(length(plain) AS INTEGER) AS n_content, authors, 'page' AS kind, type, section,
       array_to_string(tags, ';') AS tags, array_to_string(categories, ';') AS categories
FROM ({SQL_CORPUS})""")
def sea_01(spark, d):
    c = corpus(spark, d)
    return c.select("objectID", "date", "publishdate", "lastmod", "expirydate", "lang", "permalink", "relpermalink", "title", "summary",
                    F.length("content").alias("n_content"), F.array_join("authors", "; ").alias("authors"), "kind", "type", "section",
                    F.array_join("tags", ";").alias("tags"), F.array_join("categories", ";").alias("categories"))


def _fields(c):
    return {"title": c["title"], "summary": c["summary"], "authors": F.array_join(c["authors"], " "),
            "content": c["content"], "tags": F.array_join(c["tags"], " "),
            "categories": F.array_join(c["categories"], " ")}


SQL_FIELDS = {"title": "title", "summary": "summary", "authors": "authors", "content": "plain",
              "tags": "array_to_string(tags, ' ')", "categories": "array_to_string(categories, ' ')"}


_INDEX: dict[tuple[str, str], SI.SearchIndex] = {}


def stored_index(spark, d):
    """The index of the corpus of ``d``: written by the first query of the application that needs it, used by later ones
    as long as its folder is there."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEX or not path_exists(spark, f"{_INDEX[at].path}/counts/_SUCCESS"):
        c = corpus(spark, d)
        _INDEX[at] = SI.build_index(c, _fields(c), "objectID", scratch_path(spark, f"search-index-{uuid.uuid4().hex[:12]}"), keep=["section"])
    return _INDEX[at]


@register("sea-02", f"""
SELECT objectID, score FROM (SELECT objectID, round({sql_fuzzy(SQL_FIELDS, QUERY)}, 6) AS score FROM ({SQL_CORPUS}))
WHERE score > 0 ORDER BY score DESC, objectID LIMIT 20""")
def sea_02(spark, d):
    return SI.index_search(stored_index(spark, d), QUERY, k=20, digits=6)


# Localised labels of result types.
TYPE_LABELS = [("documents", "Page"), ("benchmark", "Benchmark item")]


@register("sea-05", f"""
WITH hits AS (SELECT objectID, section FROM ({SQL_CORPUS}) WHERE {sql_fuzzy(SQL_FIELDS, QUERY)} > 0)
SELECT objectID, coalesce(l.label, section) AS type_label, (SELECT count(*) FROM hits) AS n_results
FROM hits LEFT JOIN (VALUES ('documents', 'Page'), ('benchmark', 'Benchmark item')) l(sec, label) ON hits.section = l.sec""")
def sea_05(spark, d):
    hits = materialize(SI.index_hits(stored_index(spark, d), QUERY).select("objectID", "section"), "hits")
    labels = spark.createDataFrame(TYPE_LABELS, "section string, label string")
    return S.with_result_count(hits, "section", labels, "type_label").select("objectID", "type_label", "n_results")


@register("sea-03", f"""
SELECT doc_id, CASE WHEN instr(lower(t), 'the') > 0 THEN
    substring(t, greatest(instr(lower(t), 'the') - 1 - 60, 0) + 1,
              least(instr(lower(t), 'the') - 1 + 2 + 60, length(t)) - greatest(instr(lower(t), 'the') - 1 - 60, 0))
  ELSE s END AS snippet
FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN {sql_auto_summary('text')} ELSE text END AS t,
             {sql_auto_summary('text')} AS s FROM documents)""")
def sea_03(spark, d):
    docs = table(spark, d, "documents")
    section = F.when(F.col("lang") == "de", F.lit("publication")).otherwise(F.lit("page"))
    return docs.select("doc_id", S.snippet(F.col("text"), auto_summary("text"), section, "the").alias("snippet"))


@register("sea-04", """
SELECT doc_id, CAST(len(string_split(lower(text), 'the')) - 1 AS INTEGER) AS n_spans,
       regexp_replace(text, '(?i)(the)', '<mark>\\1</mark>', 'g') AS marked FROM documents""")
def sea_04(spark, d):
    docs = spread(table(spark, d, "documents"))
    spans, marked = S.highlight(F.col("text"), "the")
    return docs.select("doc_id", F.size(spans).alias("n_spans"), marked.alias("marked"))


def part_keywords(spark, d):
    p = table(spark, d, "part")
    tags = p.select("p_partkey", F.lit("tags").alias("index"), F.explode(F.split("p_name", " ")).alias("keyword"),
                    F.lit(80).alias("weight"))
    cats = p.select("p_partkey", F.lit("categories").alias("index"), F.col("p_type").alias("keyword"),
                    F.lit(70).alias("weight"))
    auth = p.select("p_partkey", F.lit("authors").alias("index"), F.col("p_brand").alias("keyword"),
                    F.lit(20).alias("weight"))
    return tags.unionByName(cats).unionByName(auth)


@register("sea-06", """
WITH kw AS (SELECT DISTINCT * FROM (
    SELECT p_partkey AS id, 'tags' AS idx, lower(unnest(string_split(p_name, ' '))) AS kw, 80.0 AS w FROM part
    UNION ALL SELECT p_partkey, 'categories', lower(p_type), 70.0 FROM part
    UNION ALL SELECT p_partkey, 'authors', lower(p_brand), 20.0 FROM part)),
own AS (SELECT id, sum(w) AS own FROM kw GROUP BY id),
pairs AS (SELECT a.id, b.id AS related_id, sum(a.w) AS shared FROM kw a JOIN kw b
          ON a.idx = b.idx AND a.kw = b.kw AND a.id <> b.id GROUP BY a.id, b.id),
sc AS (SELECT p.id, p.related_id, 100.0 * p.shared / o.own AS score FROM pairs p JOIN own o USING (id))
SELECT id AS p_partkey, related_id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, related_id) AS rank FROM sc WHERE score >= 80)
WHERE rank <= 5""")
def sea_06(spark, d):
    return related("p_partkey", part_keywords(spark, d), threshold=80.0, k=5)


def text_keywords(spark, d):
    """The five indices over ``documents``: words of the title (first line) and of the summary, tag, category, author."""
    docs = table(spark, d, "documents")
    title, plain = F.regexp_extract("text", FIRST_LINE, 0), F.col("text")
    words = lambda x: F.filter(F.split(F.lower(x), r"[\s.,;:!?]+"), lambda t: t != "")
    one = lambda c: F.array(F.lower(c))
    indices = [("title", words(title), 60), ("summary", words(auto_summary(plain)), 50), ("tags", one("lang"), 80),
               ("categories", one("source"), 70), ("authors", one(F.concat(F.lit("by "), "source")), 20)]
    each = F.array(*[F.struct(F.lit(n).alias("index"), F.array_distinct(k).alias("ks"), F.lit(w).alias("weight")) for n, k, w in indices])
    rows = docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.index", "x.weight", F.explode("x.ks").alias("keyword"))
    return rows.select("doc_id", "index", "keyword", "weight")


@register("sea-06-text", f"""
WITH kw AS (SELECT DISTINCT * FROM (
    SELECT doc_id AS id, 'title' AS idx, unnest(regexp_split_to_array(lower(regexp_extract(text, '^[^\\n]*', 0)), '[\\s.,;:!?]+')) AS kw, 60.0 AS w FROM documents
    UNION ALL SELECT doc_id, 'summary', unnest(regexp_split_to_array(lower({sql_auto_summary('text')}), '[\\s.,;:!?]+')), 50.0 FROM documents
    UNION ALL SELECT doc_id, 'tags', lower(lang), 80.0 FROM documents
    UNION ALL SELECT doc_id, 'categories', lower(source), 70.0 FROM documents
    UNION ALL SELECT doc_id, 'authors', 'by ' || lower(source), 20.0 FROM documents) WHERE kw <> ''),
own AS (SELECT id, sum(w) AS own FROM kw GROUP BY id),
pairs AS (SELECT a.id, b.id AS related_id, sum(a.w) AS shared FROM kw a JOIN kw b
          ON a.idx = b.idx AND a.kw = b.kw AND a.id <> b.id GROUP BY a.id, b.id),
sc AS (SELECT p.id, p.related_id, 100.0 * p.shared / o.own AS score FROM pairs p JOIN own o USING (id))
SELECT id AS doc_id, related_id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, related_id) AS rank FROM sc WHERE score >= 80)
WHERE rank <= 5""")
def sea_06_text(spark, d):
    return related("doc_id", text_keywords(spark, d), threshold=80.0, k=5)


@register("sea-06-null", """
WITH kw AS (SELECT DISTINCT * FROM (
    SELECT p_partkey AS id, 'tags' AS idx, CASE WHEN p_partkey % 3 > 0 THEN lower(split_part(p_name, ' ', 1)) END AS kw, 80.0 AS w FROM part
    UNION ALL SELECT p_partkey, 'categories', CASE WHEN p_partkey % 4 > 0 THEN lower(p_type) ELSE '' END, 70.0 FROM part
    UNION ALL SELECT p_partkey, 'authors', 'Shop', 20.0 FROM part) WHERE kw <> ''),
own AS (SELECT id, sum(w) AS own FROM kw GROUP BY id),
pairs AS (SELECT a.id, b.id AS related_id, sum(a.w) AS shared FROM kw a JOIN kw b
          ON a.idx = b.idx AND a.kw = b.kw AND a.id <> b.id GROUP BY a.id, b.id),
sc AS (SELECT p.id, p.related_id, 100.0 * p.shared / o.own AS score FROM pairs p JOIN own o USING (id))
SELECT id AS p_partkey, related_id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, related_id) AS rank FROM sc WHERE score >= 80)
WHERE rank <= 5""")
def sea_06_null(spark, d):
    """Tags of one word, missing in a third of the items; categories empty in a quarter; one author on every item."""
    p = table(spark, d, "part")
    rows = [(F.lit("tags"), F.when(F.col("p_partkey") % 3 > 0, F.split_part("p_name", F.lit(" "), F.lit(1))), 80),
            (F.lit("categories"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_type")).otherwise(""), 70), (F.lit("authors"), F.lit("Shop"), 20)]
    each = F.array(*[F.struct(i.alias("index"), kw.alias("keyword"), F.lit(w).alias("weight")) for i, kw, w in rows])
    return related("p_partkey", p.select("p_partkey", F.explode(each).alias("x")).select("p_partkey", "x.*"), threshold=80.0, k=5)


@register("sea-07", """
SELECT conv_id, count(*) AS n_matches, max(turn) AS last_match, arg_max(text, turn) AS last_text FROM conversations
WHERE contains(lower(text), 'the') OR contains(lower(text), 'la') GROUP BY conv_id""")
def sea_07(spark, d):
    return S.conversation_search(table(spark, d, "conversations"), "conv_id", "turn", "text", "the OR la")
