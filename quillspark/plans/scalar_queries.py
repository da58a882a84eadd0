"""FN-*: scalar functions, each applied to a whole column of a test table."""

from pyspark.sql import functions as F

from quillspark.functions import arrays as AR
from quillspark.functions import cases as C
from quillspark.functions import dates as D
from quillspark.functions import text as T
from quillspark.operators.aggregates import term_counts
from quillspark.functions.nulls import tolerant
from quillspark.plans.registry import register
from quillspark.plans.tables import table
from quillspark.session import spread

FIRST_LINE = r"^[^\n]*"
ACC, FOLD = T.ACCENTED, T.FOLDED


def _docs(spark, d):
    return table(spark, d, "documents")


@register("fn-s1", "SELECT doc_id, substring(text, 3, 7) AS part FROM documents")
def fn_s1(spark, d):
    return _docs(spark, d).select("doc_id", T.substr_range("text", 3, 9).alias("part"))


@register("fn-s2", "SELECT c_custkey, regexp_matches(c_name, '[0]') AS has_zero FROM customer")
def fn_s2(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.matches("c_name", "[0]").alias("has_zero"))


@register("fn-s3", """
SELECT p_partkey, regexp_replace(p_name, 'r', 'R') AS first_r, regexp_replace(p_name, 'e', 'E', 'g') AS all_e FROM part""")
def fn_s3(spark, d):
    return table(spark, d, "part").select("p_partkey", T.replace_first("p_name", "r", "R").alias("first_r"),
                                          T.replace_all("p_name", "e", "E").alias("all_e"))


@register("fn-s4", "SELECT p_partkey, split_part(p_brand, '#', 2) || '_' || split_part(p_brand, '#', 1) AS swapped FROM part")
def fn_s4(spark, d):
    return table(spark, d, "part").select("p_partkey", T.swap_parts("p_brand", "#").alias("swapped"))


@register("fn-s5", rf"""
SELECT doc_id, regexp_replace(regexp_replace(trim(translate(lower(regexp_replace(text,
         '<[^>]*>', '', 'g')), '{ACC}', '{FOLD}')), '\s+', '-', 'g'), '[^a-z0-9_\-#.+~]', '', 'g') AS slug
FROM documents""")
def fn_s5(spark, d):
    return _docs(spark, d).select("doc_id", T.slug("text").alias("slug"))


@register("fn-s6", r"""
SELECT page_id, trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
                                  '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
  '\s+', ' ', 'g')) AS plain FROM pages""")
def fn_s6(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html("html").alias("plain"))


@register("fn-s7", r"""
SELECT doc_id, CASE WHEN length(text) <= 250 THEN text ELSE
  regexp_replace(CASE WHEN regexp_extract(substring(text, 1, 251), '(?s)^(.*)\s', 1) = '' THEN substring(text, 1, 250)
                      ELSE regexp_extract(substring(text, 1, 251), '(?s)^(.*)\s', 1) END, '\s+$', '') || '…' END AS teaser
FROM documents""")
def fn_s7(spark, d):
    return _docs(spark, d).select("doc_id", T.truncate("text", 250).alias("teaser"))


@register("fn-s8", r"""
SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:30], ' ') AS summary
FROM documents""")
def fn_s8(spark, d):
    return _docs(spark, d).select("doc_id", T.auto_summary("text").alias("summary"))


@register("fn-s9", r"""
SELECT doc_id, CAST(ceil(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) / 213) AS BIGINT) AS minutes
FROM documents""")
def fn_s9(spark, d):
    return _docs(spark, d).select("doc_id", T.reading_time("text").alias("minutes"))


@register("fn-s10", r"""
SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$', 0) AS base,
       printf('%s-%d', split_part(url, '/', 1), page_id) AS label FROM pages""")
def fn_s10(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.last_path_part("url").alias("base"),
                    F.format_string("%s-%d", F.split("url", "/")[0], "page_id").alias("label"))


@register("fn-s11", """
SELECT p_partkey, 'js-id-' || replace(p_name, ' ', '-') || ' ' || 'js-id-' || replace(p_type, ' ', '-') AS classes FROM part""")
def fn_s11(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(T.css_ids(F.array("p_name", "p_type")), " ").alias("classes"))


@register("fn-s12", """
SELECT c_custkey, coalesce(c_name || ', ', '') || coalesce(n_name || ', ', '') ||
       coalesce(nullif(c_mktsegment, '') || ' ', '') || CAST(c_custkey AS VARCHAR) AS address
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def fn_s12(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    fields = {"street": F.col("c_name"), "city": F.col("n_name"), "region": F.col("c_mktsegment"),
              "postcode": F.col("c_custkey").cast("string")}
    # The en-us address format (order and delimiters).
    addr = T.assemble(fields, ["street", "city", "region", "postcode"], [", ", ", ", " ", ""])
    return c.select("c_custkey", addr.alias("address"))


@register("fn-s13", r"""
SELECT page_id, replace(replace('https://share.example/?u={url}&t={title}', '{url}', url_encode(url)),
                        '{title}', url_encode('page ' || page_id)) AS share,
       CASE WHEN lower(url) LIKE 'mailto:%' THEN 'email' WHEN lower(url) LIKE 'https://%' THEN 'secure'
            WHEN lower(url) LIKE 'http://%' THEN 'web' ELSE 'relative' END AS scheme,
       CASE WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) = '' THEN NULL
            ELSE url_decode(replace(regexp_extract(url, '[?&]page=([^&#]*)', 1), '+', ' ')) END AS page_param
FROM pages""")
def fn_s13(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id",
                    T.share_url("https://share.example/?u={url}&t={title}", "url",
                                F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("share"),
                    T.link_scheme("url").alias("scheme"), T.query_param("url", "page").alias("page_param"))


@register("fn-s14", """
SELECT c_custkey, md5(lower(trim(lower(replace(c_name, '#', '.')) || '@example.org'))) AS avatar FROM customer""")
def fn_s14(spark, d):
    c = table(spark, d, "customer")
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org"))
    return c.select("c_custkey", T.email_hash(email).alias("avatar"))


@register("fn-s15", r"SELECT doc_id, regexp_replace(text, '\s*https://t\.co\S*$', '') AS clean FROM documents")
def fn_s15(spark, d):
    return _docs(spark, d).select("doc_id", T.drop_short_link("text").alias("clean"))


@register("fn-s16", """
SELECT conv_id, turn, CASE WHEN turn > 0 THEN 'reply' WHEN text LIKE 'RT @%' THEN 'repost' ELSE 'original' END AS kind
FROM conversations""")
def fn_s16(spark, d):
    c = table(spark, d, "conversations")
    reply_to = F.when(F.col("turn") > 0, F.col("turn") - 1)
    return c.select("conv_id", "turn", T.post_kind(reply_to, "text").alias("kind"))


@register("fn-s17", """
SELECT doc_id, 'by' || CASE WHEN quality = 1 THEN '' ELSE '-nc' END ||
       CASE WHEN toxic = 0 THEN '' WHEN quality = 1 THEN '-sa' ELSE '-nd' END AS licence FROM labels""")
def fn_s17(spark, d):
    lab = table(spark, d, "labels")
    return lab.select("doc_id", T.licence_code(F.col("quality") == 1, F.col("toxic") == 0,
                                               F.col("quality") == 1).alias("licence"))


@register("fn-s18", """
SELECT o_orderkey,
  c_name || ' (' || CAST(year(o_orderdate) AS VARCHAR) || '). ' || o_orderpriority || '. ' || o_orderstatus || '.' AS apa,
  c_name || '. "' || o_orderpriority || '." ' || o_orderstatus || ', ' || CAST(year(o_orderdate) AS VARCHAR) || '.' AS mla
FROM orders JOIN customer ON o_custkey = c_custkey""")
def fn_s18(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = F.array("c_name")
    return o.select("o_orderkey",
                    T.citation("apa", a, F.year("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("apa"),
                    T.citation("mla", a, F.year("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("mla"))


@register("fn-d1", "SELECT event_id, date_trunc('second', ts) AS ts_s FROM events")
def fn_d1(spark, d):
    return table(spark, d, "events").select("event_id", D.from_epoch(D.epoch_seconds("ts")).alias("ts_s"))


@register("fn-d2", """
SELECT l_orderkey, l_linenumber, l_partkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS secs,
       CASE WHEN epoch(l_shipdate) - epoch(o_orderdate) < 0 THEN '-' ELSE '' END ||
       printf('%d:%02d:%02d', CAST(floor(abs(epoch(l_shipdate) - epoch(o_orderdate))) AS BIGINT) // 3600,
              (CAST(floor(abs(epoch(l_shipdate) - epoch(o_orderdate))) AS BIGINT) % 3600) // 60,
              CAST(floor(abs(epoch(l_shipdate) - epoch(o_orderdate))) AS BIGINT) % 60) AS hms
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def fn_d2(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    secs = D.seconds_between("o_orderdate", "l_shipdate")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", secs.alias("secs"), D.hms(secs).alias("hms"))


@register("fn-d3", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%B %Y') AS month_year,
       strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS rfc, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso
FROM orders""")
def fn_d3(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"), D.fmt("o_orderdate", D.MONTH_YEAR).alias("month_year"),
                    D.fmt("o_orderdate", D.RFC822).alias("rfc"), D.fmt("o_orderdate", D.ISO).alias("iso"))


@register("fn-d4", """
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(' ', strftime(s, '%b %-d, %Y'), CASE WHEN NOT ad THEN strftime(s, '%H:%M') END,
       CASE WHEN e IS NOT NULL THEN '&mdash;' END,
       CASE WHEN e IS NOT NULL AND CAST(s AS DATE) <> CAST(e AS DATE) THEN strftime(e, '%b %-d, %Y') END,
       CASE WHEN e IS NOT NULL AND NOT ad THEN strftime(e, '%H:%M') END) AS event_dates
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS s, l_linestatus = 'F' AS ad,
             CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 2 DAY
                  WHEN l_returnflag = 'A' THEN l_shipdate + INTERVAL 3 HOUR END AS e FROM lineitem)""")
def fn_d4(spark, d):
    li = table(spark, d, "lineitem")
    end = (F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 2 DAYS"))
           .when(F.col("l_returnflag") == "A", F.col("l_shipdate") + F.expr("INTERVAL 3 HOURS")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     D.event_range("l_shipdate", end, F.col("l_linestatus") == "F").alias("event_dates"))


@register("fn-d5", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def fn_d5(spark, d):
    ev = table(spark, d, "events")
    text = D.fmt("ts", D.ARCHIVE_FORMAT)
    return ev.select("event_id", D.parse_archive_time(text).alias("parsed"))


@register("fn-d6", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def fn_d6(spark, d):
    ev = table(spark, d, "events")
    loose = F.concat_ws("", F.year("ts").cast("string"), F.lit("-"), F.month("ts").cast("string"), F.lit("-"),
                        F.dayofmonth("ts").cast("string"), F.lit("T"), F.hour("ts").cast("string"), F.lit(":"),
                        F.lpad(F.minute("ts").cast("string"), 2, "0"), F.lit(":"),
                        F.lpad(F.floor(F.second("ts")).cast("string"), 2, "0"), F.lit("Z"))
    return ev.select("event_id", D.parse_loose_iso(loose).alias("parsed"))


@register("fn-d7", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def fn_d7(spark, d):
    ev = table(spark, d, "events")
    text = F.when(F.col("event_type").isin("click", "view"), D.fmt("ts", "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(D.fmt("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return ev.select("event_id", D.parse_utc_or_iso(text).alias("parsed"))


@register("fn-d8", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM events")
def fn_d8(spark, d):
    return table(spark, d, "events").select("event_id", D.epoch_seconds("ts").alias("epoch_s"))


@register("fn-m1", """
WITH c AS (SELECT lower(unnest(regexp_split_to_array(p_name, ' '))) AS term, count(*) AS n FROM part GROUP BY term),
top AS (SELECT * FROM c ORDER BY n DESC, term LIMIT 20),
b AS (SELECT min(n) AS lo, max(n) + 1 AS hi FROM top)
SELECT term, n, round((ln(n) - ln(lo)) / (ln(hi) - ln(lo)), 6) AS weight,
       round(0.8 + 1.7 * (ln(n) - ln(lo)) / (ln(hi) - ln(lo)), 6) AS font_size FROM top, b""")
def fn_m1(spark, d):
    counts = term_counts(table(spark, d, "part"), F.split("p_name", " "))
    top = counts.orderBy(F.col("n").desc(), "term").limit(20)
    lo = top.select(F.min("n")).scalar()
    hi = top.select(F.max("n") + 1).scalar()
    w = C.log_weight(F.col("n"), lo, hi)
    return top.select("term", "n", F.round(w, 6).alias("weight"), F.round(C.font_size(w), 6).alias("font_size"))


@register("fn-m2", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 2 THEN l_tax WHEN l_linenumber = 1 THEN 0.0032 * l_extendedprice
       WHEN l_linenumber = 2 THEN 0.0032 * l_quantity END AS bonus FROM lineitem""")
def fn_m2(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     C.bonus("l_linenumber", "l_tax", "l_extendedprice", "l_quantity").alias("bonus"))


@register("fn-c1", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '/fr/') THEN 'French' WHEN regexp_matches(url, '//m\.') THEN 'Mobile'
                     WHEN regexp_matches(url, 'page=') THEN 'Paged' ELSE 'Desktop' END AS kind FROM pages""")
def fn_c1(spark, d):
    p = table(spark, d, "pages")
    kind = C.first_match([(F.col("url").rlike("/fr/"), "French"), (F.col("url").rlike(r"//m\.") , "Mobile"),
                          (F.col("url").rlike("page="), "Paged")], "Desktop")
    return p.select("page_id", kind.alias("kind"))


# Code -> label of the survey's gender item.
GENDER = {0: "Male", 1: "Female", 2: "Non-binary", 3: "Rather not say"}


@register("fn-c2", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber - 1 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female'
       WHEN 2 THEN 'Non-binary' WHEN 3 THEN 'Rather not say' END AS label FROM lineitem""")
def fn_c2(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", C.code_label(F.col("l_linenumber") - 1, GENDER).alias("label"))


@register("fn-c3", r"""
SELECT page_id, TRY_CAST(regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1) AS INTEGER) AS num FROM pages""")
def fn_c3(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", tolerant(F.regexp_extract("url", r"/([^/?#]*)([?#].*)?$", 1), "int").alias("num"))


@register("fn-c4", """
SELECT event_id, CAST(regexp_matches(k, '[0]') AS INTEGER) AS work_0, CAST(regexp_matches(k, '[1]') AS INTEGER) AS work_1,
       CAST(regexp_matches(k, '[2]') AS INTEGER) AS work_2, CAST(regexp_matches(k, '[3]') AS INTEGER) AS work_3,
       CAST(regexp_matches(k, '[4]') AS INTEGER) AS work_4
FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def fn_c4(spark, d):
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return ev.select("event_id", *[v.alias(k) for k, v in C.one_hot("k", ["0", "1", "2", "3", "4"], "work_").items()])


@register("fn-c5", """
SELECT conv_id, turn, coalesce(CASE WHEN role = 'system' THEN 7 END, CASE WHEN role = 'assistant' THEN turn * 10 + 1 END,
                               CASE WHEN role = 'user' THEN turn * 10 END, 0) AS msg_time FROM conversations""")
def fn_c5(spark, d):
    c = table(spark, d, "conversations")
    kinds = [F.when(F.col("role") == "user", F.col("turn") * 10), F.when(F.col("role") == "assistant", F.col("turn") * 10 + 1),
             F.when(F.col("role") == "system", F.lit(7).cast("bigint"))]
    return c.select("conv_id", "turn", C.latest_of(*kinds).alias("msg_time"))


@register("fn-a1", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n_words,
       list_contains(string_split(p_name, ' '), 'red') AS has_red,
       CAST(len(list_append(string_split(p_name, ' '), p_type)) AS INTEGER) AS n_with_type,
       len(list_intersect(string_split(p_name, ' '), ['red', 'blue'])) > 0 AS warm_or_cold FROM part""")
def fn_a1(spark, d):
    p = table(spark, d, "part").withColumn("w", F.split("p_name", " "))
    return p.select("p_partkey", F.element_at("w", 1).alias("first_word"), F.size("w").alias("n_words"),
                    F.array_contains("w", "red").alias("has_red"),
                    F.size(F.concat("w", F.array("p_type"))).alias("n_with_type"),
                    F.arrays_overlap("w", F.array(F.lit("red"), F.lit("blue"))).alias("warm_or_cold"))


@register("fn-a2", """
WITH p AS (SELECT doc_id, string_split(lower(text), 'the') AS a, string_split(lower(text), 'he ') AS b FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(a)),
             lambda i: list_sum(list_transform(a[1:i], lambda x: length(x))) + (i - 1) * 3)) AS st FROM p
      UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, len(b)),
             lambda i: list_sum(list_transform(b[1:i], lambda x: length(x))) + (i - 1) * 3)) AS st FROM p),
e AS (SELECT doc_id, st, st + 2 AS en FROM s),
f AS (SELECT *, CASE WHEN st <= max(en) OVER (PARTITION BY doc_id ORDER BY st, en
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM e),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
      FROM f),
h AS (SELECT doc_id, isl, max(en) - min(st) + 1 AS len FROM g GROUP BY doc_id, isl)
SELECT d.doc_id, CAST(count(h.isl) AS INTEGER) AS n_spans, CAST(coalesce(sum(h.len), 0) AS INTEGER) AS covered
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id""")
def fn_a2(spark, d):
    docs = spread(_docs(spark, d))
    spans = F.concat(AR.hit_spans("text", "the"), AR.hit_spans("text", "he "))
    merged = docs.select("doc_id", AR.merge_spans(spans).alias("m"))    # computed once
    return merged.select("doc_id", F.size("m").alias("n_spans"),
                         F.aggregate("m", F.lit(0), lambda a, s: a + s["end"] - s["start"] + 1).alias("covered"))


@register("fn-a3", """
SELECT doc_id, CAST(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda l: length(l) > 0),
                                          lambda l: length(l))) AS INTEGER) AS line_chars
FROM documents""")
def fn_a3(spark, d):
    docs = _docs(spark, d)
    lens = AR.filter_map(F.split("text", "\n"), lambda l: F.length(l) > 0, lambda l: F.length(l))
    return docs.select("doc_id", AR.array_sum(lens).alias("line_chars"))


@register("fn-j1", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(to_json({'event_id': event_id, 'k': CAST(json_extract_string(props, '$.k') AS INTEGER)}) AS VARCHAR) AS doc FROM events""")
def fn_j1(spark, d):
    ev = table(spark, d, "events").withColumn("p", AR.parse_props("props"))
    return ev.select("event_id", F.col("p.k").alias("k"),
                     F.to_json(F.struct("event_id", F.col("p.k").alias("k"))).alias("doc"))


@register("fn-k1", """
SELECT event_id, true AS has_k, 'count' AS unit, 2 AS n_keys, json_extract_string(props, '$.k') AS k FROM events""")
def fn_k1(spark, d):
    ev = table(spark, d, "events")
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    merged = AR.with_defaults(m, {"k": "0", "unit": "count"})
    return ev.select("event_id", F.map_contains_key(m, "k").alias("has_k"), merged["unit"].alias("unit"),
                     F.size(merged).alias("n_keys"), merged["k"].alias("k"))


@register("fn-s12-row", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment || ' ' || c_name || ', ' || CAST(c_custkey AS VARCHAR)
                       ELSE c_name || ', ' || c_mktsegment || CAST(c_custkey AS VARCHAR) END AS address FROM customer""")
def fn_s12_row(spark, d):
    fields = {"street": F.col("c_name"), "region": F.col("c_mktsegment"), "postcode": F.col("c_custkey").cast("string")}
    formats = {"a": (["street", "region", "postcode"], [", "]), "b": (["region", "street", "postcode"], [" ", ", "])}
    name = F.when(F.col("c_mktsegment") == "BUILDING", "b").when(F.col("c_mktsegment") == "MACHINERY", "unknown")
    return table(spark, d, "customer").select("c_custkey", T.assemble_by(fields, formats, name, "a").alias("address"))


@register("fn-s18-null", """
SELECT o_orderkey, c_name || ' (' || CAST(year(o_orderdate) AS VARCHAR) || '). ' || o_orderpriority || '.' ||
       CASE WHEN o_orderstatus = 'F' THEN ' Final.' WHEN o_orderstatus = 'O' THEN ' ' || o_orderstatus || '.' ELSE '' END AS apa
FROM orders JOIN customer ON o_custkey = c_custkey""")
def fn_s18_null(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    short = F.when(F.col("o_orderstatus") == "F", "Final").otherwise("")
    full = F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus"))
    return o.select("o_orderkey", T.citation("apa", F.array("c_name"), F.year("o_orderdate"), F.col("o_orderpriority"), T.venue(short, full)).alias("apa"))


@register("flt-09-type", """
SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderstatus = 'P' THEN '0' ELSE o_orderpriority END) IN ('0', '1-URGENT')""")
def flt_09_type(spark, d):
    types = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    return table(spark, d, "orders").where(T.first_type(types).isin("0", "1-URGENT")).select("o_orderkey")


@register("prj-08-site", r"""
SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN lang = 'de' THEN 'Doc ' || CAST(doc_id AS VARCHAR) ELSE 'All documents' END AS description
FROM documents""")
def prj_08_site(spark, d):
    own = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    desc = T.page_description(F.lit(""), F.when(F.col("lang") == "en", F.col("source")), own, F.col("lang") == "de", "All documents", "Owner")
    return table(spark, d, "documents").select("doc_id", desc.alias("description"))
