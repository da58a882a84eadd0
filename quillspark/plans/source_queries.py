"""SRC-* and SNK-*: every query writes derived data of a test table to the
shared checkpoint folder with the sink under test and reads it back with
the matching source, so the round trip is checked against the table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.plans.registry import register
from quillspark.plans.search_queries import SQL_CORPUS, corpus
from quillspark.plans.tables import table
from quillspark.sources import archive as AR
from quillspark.sources import files as FS
from quillspark.sources import frontmatter as FM
from quillspark.sources import lookup as LK
from quillspark.sources import sinks as SK

EVENT_DDL = "struct<event_id: bigint, ts: timestamp_ntz, user_id: bigint, event_type: string, value: double, props: string>"
PART_ROWS = 1000   # records per archive part


@register("src-01", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_01(spark, d):
    path = FS.new_path(spark, "nation-csv")
    FS.write_csv(table(spark, d, "nation"), path)
    return FS.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def _archive(spark, d):
    """The folder of the parts, and their catalog."""
    path = FS.new_path(spark, "archive")
    return path, AR.write_parts(table(spark, d, "events"), path, "event", "event", F.floor(F.col("event_id") / PART_ROWS), "event_id")


@register("src-02", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def src_02(spark, d):
    return AR.read_parts(spark, _archive(spark, d)[0], "event", EVENT_DDL)


@register("src-03", f"""
SELECT 'event' AS data_type, 'YTD.event.part' || CAST(event_id // {PART_ROWS} AS VARCHAR) AS globalName,
       count(*) AS declared, count(*) AS actual, true AS ok FROM events GROUP BY event_id // {PART_ROWS}""")
def src_03(spark, d):
    parts, catalog = _archive(spark, d)
    mpath = FS.new_path(spark, "manifest")
    AR.write_manifest(catalog, mpath)
    checked = AR.check_manifest(AR.read_manifest(spark, mpath), AR.part_counts(spark, parts))
    return checked.select("data_type", "globalName", "declared", "actual", "ok")


@register("src-03-types", f"""
WITH e AS (SELECT CASE WHEN event_id = 0 THEN 'account' ELSE event_type END AS t, event_id // {PART_ROWS} AS part FROM events),
p AS (SELECT t, part, count(*) AS n FROM e GROUP BY ALL)
SELECT t AS data_type, count(*) AS files, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(n) AS BIGINT) AS actual, true AS ok, t = 'account' AS single,
       (SELECT count(*) FROM events) AS written FROM p GROUP BY t""")
def src_03_types(spark, d):
    """Parts of several data types, one of which is a single file with a single entry; what the write saw beside what is read."""
    ev, path, mpath = table(spark, d, "events"), FS.new_path(spark, "archive"), FS.new_path(spark, "manifest")
    kind = F.when(F.col("event_id") == 0, "account").otherwise(F.col("event_type"))
    catalog = AR.write_parts(ev, path, kind, "event", F.floor(F.col("event_id") / PART_ROWS), "event_id")
    AR.write_manifest(catalog, mpath)
    checked = AR.check_manifest(AR.read_manifest(spark, mpath), AR.part_counts(spark, path))
    return AR.type_assertions(checked).withColumn("written", catalog.select(F.max("written")).scalar())


@register("src-03-single", "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_id = 0")
def src_03_single(spark, d):
    """The one record of the data type that must be one file with one entry."""
    ev, path, mpath = table(spark, d, "events"), FS.new_path(spark, "archive"), FS.new_path(spark, "manifest")
    kind = F.when(F.col("event_id") == 0, "account").otherwise("event")
    AR.write_manifest(AR.write_parts(ev, path, kind, "event", F.floor(F.col("event_id") / PART_ROWS), "event_id"), mpath)
    return AR.single_entry(AR.read_parts(spark, f"{path}/_type=account", "event", EVENT_DDL), AR.read_manifest(spark, mpath), "account")


@register("src-04", """
SELECT CAST(doc_id AS VARCHAR) AS doc_key, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, lang,
       source || ',' || lang AS tags, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (doc_id % 28) DAY AS date,
       CAST(length(text) AS INTEGER) AS body_chars, CASE WHEN lang = 'de' THEN 'toml' ELSE 'yaml' END AS format
FROM documents""")
def src_04(spark, d):
    docs = table(spark, d, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("string")
    yaml_head = F.concat(F.lit("---\ntitle: 'Doc "), F.col("doc_id").cast("string"), F.lit("'\ndate: "), day,
                         F.lit("\nlang: "), F.col("lang"), F.lit("\ntags: ["), F.col("source"), F.lit(", "),
                         F.col("lang"), F.lit("]\n---\n"))
    toml_head = F.concat(F.lit('+++\ntitle = "Doc '), F.col("doc_id").cast("string"), F.lit('"\ndate = '), day,
                         F.lit('\nlang = "'), F.col("lang"), F.lit('"\ntags = ["'), F.col("source"), F.lit('", "'),
                         F.col("lang"), F.lit('"]\n+++\n'))
    texts = docs.select(F.col("doc_id").alias("path"), F.concat(
        F.when(F.col("lang") == "de", toml_head).otherwise(yaml_head), F.col("text")).alias("value"))
    parsed = FM.parse_documents(texts, "value", "path")
    return parsed.select("doc_key", "title", "lang", F.array_join("tags", ",").alias("tags"), "date",
                         F.length("body").alias("body_chars"), "format")


# Publication types by position.
PUB_TYPES_TOML = '''types = [ "pub_uncat", "pub_conf", "pub_journal", "pub_preprint", "pub_report",
          "pub_book", "pub_book_section", "pub_thesis", "pub_patent" ]'''


@register("src-05", """
SELECT r_regionkey, r_name, t.label_id FROM region LEFT JOIN (VALUES (0, 'pub_uncat'), (1, 'pub_conf'),
  (2, 'pub_journal'), (3, 'pub_preprint'), (4, 'pub_report'), (5, 'pub_book'), (6, 'pub_book_section'),
  (7, 'pub_thesis'), (8, 'pub_patent')) t(pos, label_id) ON r_regionkey = t.pos""")
def src_05(spark, d):
    lk = LK.from_toml_list(spark, PUB_TYPES_TOML, "types")
    r = table(spark, d, "region")
    return r.join(lk, r["r_regionkey"] == lk["pos"], "left").select("r_regionkey", "r_name", "label_id")


@register("src-06", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')")
def src_06(spark, d):
    path = FS.new_path(spark, "events-split")
    FS.write_split(table(spark, d, "events"), path, "event_type")
    # Exclusion patterns for the folders written above.
    df = FS.read_excluding(spark, path, [r"event_type=error/", r"event_type=signup/", r"\.crc$"])
    return df.select("event_id", "event_type")


@register("snk-01", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def snk_01(spark, d):
    path = FS.new_path(spark, "customer-csv")
    FS.write_csv(table(spark, d, "customer"), path)
    return FS.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                                    "c_mktsegment string")


@register("snk-02", f"SELECT objectID, title, summary, lang FROM ({SQL_CORPUS})")
def snk_02(spark, d):
    path = FS.new_path(spark, "corpus-json")
    SK.write_corpus(corpus(spark, d), path)
    return spark.read.schema("objectID string, title string, summary string, lang string").json(path)


@register("snk-03", """
SELECT o_orderpriority, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
       '/orders/' || CAST(o_orderkey AS VARCHAR) AS link,
       strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS pubDate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn <= 10""")
def snk_03(spark, d):
    o = table(spark, d, "orders")
    items = SK.feed_items(o, "o_orderpriority", "o_orderdate", "o_orderkey", 10,
                          F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
                          F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")))
    path = FS.new_path(spark, "feeds")
    SK.write_feeds(items, path, "o_orderpriority")
    back = (spark.read.format("xml").option("rowTag", "item")
            .schema("title string, link string, guid string, pubDate string, o_orderpriority string").load(path))
    return back.select("o_orderpriority", "title", "link", "pubDate")


@register("snk-04", "SELECT event_id, user_id, event_type FROM events")
def snk_04(spark, d):
    path = FS.new_path(spark, "events-by-type")
    FS.write_split(table(spark, d, "events"), path, "event_type")
    return spark.read.parquet(path).select("event_id", "user_id", "event_type")


@register("snk-05", r"""
SELECT doc_id, CAST(to_json(CASE WHEN lang = 'en' THEN
    {'@context': 'https://schema.org', '@type': 'Article', 'headline': 'Doc ' || CAST(doc_id AS VARCHAR), 'inLanguage': lang}
  ELSE {'@context': 'https://schema.org', '@type': 'WebPage', 'headline': 'Doc ' || CAST(doc_id AS VARCHAR), 'inLanguage': lang}
  END) AS VARCHAR) AS jsonld FROM documents""")
def snk_05(spark, d):
    docs = table(spark, d, "documents")
    kind = F.when(F.col("lang") == "en", F.lit("Article")).otherwise(F.lit("WebPage"))
    return docs.select("doc_id", SK.jsonld(kind, {
        "headline": F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), "inLanguage": F.col("lang")}).alias("jsonld"))


@register("snk-03-channel", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
                  max(o_orderdate) OVER (PARTITION BY o_orderpriority) AS newest FROM orders)
SELECT o_orderpriority, o_orderpriority || ' | Orders' AS title, '/priority/' || o_orderpriority AS link, o_orderpriority AS description,
       strftime(newest, '%a, %d %b %Y %H:%M:%S +0000') AS lastBuildDate, 'Order ' || CAST(o_orderkey AS VARCHAR) AS item_title,
       'Status ' || o_orderstatus AS item_description FROM x WHERE rn <= 10""")
def snk_03_channel(spark, d):
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    items = o.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10).select(
        "o_orderpriority", "rank", F.col("o_orderdate").alias("date"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("Status "), "o_orderstatus").alias("description"))
    p = F.col("o_orderpriority")
    channels = SK.feed_channels(items, "o_orderpriority", F.concat(p, F.lit(" | Orders")), F.concat(F.lit("/priority/"), p), p)
    path = FS.new_path(spark, "channels")
    SK.write_channels(channels, path, "o_orderpriority")
    back = (spark.read.format("xml").option("rowTag", "channel").schema(
        "title string, link string, description string, lastBuildDate string, item array<struct<title: string, description: string>>, o_orderpriority string").load(path))
    return back.select("o_orderpriority", "title", "link", "description", "lastBuildDate", F.explode("item").alias("x")) \
        .select("o_orderpriority", "title", "link", "description", "lastBuildDate", F.col("x.title").alias("item_title"), F.col("x.description").alias("item_description"))


@register("snk-05-article", r"""
SELECT doc_id, kind, page_id, author, publisher, logo, headline FROM (
  SELECT doc_id, CASE WHEN lang = 'en' THEN 'BlogPosting' ELSE 'Article' END AS kind, '/doc/' || CAST(doc_id AS VARCHAR) AS page_id,
         CASE WHEN source <> 'src0' THEN source END AS author, 'Publisher' AS publisher, '/logo.png' AS logo,
         'Doc ' || CAST(doc_id AS VARCHAR) AS headline FROM documents)""")
def snk_05_article(spark, d):
    docs, text = table(spark, d, "documents"), F.col("doc_id").cast("string")
    day = F.lit("2024-01-01T00:00:00Z")
    rec = SK.article_record(F.col("lang") == "en", F.concat(F.lit("/doc/"), text), F.concat(F.lit("Doc "), text), day, day,
                            F.when(F.col("source") != "src0", F.col("source")), "Publisher", "/logo.png", F.lit("A document"))
    j = docs.select("doc_id", rec.alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return j.select("doc_id", at("$['@type']").alias("kind"), at("$.mainEntityOfPage['@id']").alias("page_id"), at("$.author.name").alias("author"),
                    at("$.publisher.name").alias("publisher"), at("$.publisher.logo.url").alias("logo"), at("$.headline").alias("headline"))


@register("src-05-yaml", """
SELECT p_partkey, t.translation AS label FROM part
LEFT JOIN (VALUES ('1', 'One'), ('2', 'Two'), ('3', NULL)) t(id, translation) ON CAST(p_size AS VARCHAR) = t.id""")
def src_05_yaml(spark, d):
    text = "- id: '1'\n  translation: One\n- id: '2'\n  translation: Two\n- id: '3'\n"
    labels = LK.from_yaml_pairs(spark, text).withColumnRenamed("translation", "label")
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("id"))
    return p.join(labels, "id", "left").select("p_partkey", "label")


@register("snk-03-collection", """
WITH both_ AS (SELECT *, o_orderpriority AS collection FROM orders UNION ALL SELECT *, NULL FROM orders),
x AS (SELECT *, row_number() OVER w AS rn, max(o_orderdate) OVER (PARTITION BY collection) AS newest FROM both_ WINDOW w AS (PARTITION BY collection ORDER BY o_orderdate DESC, o_orderkey DESC))
SELECT collection, CASE WHEN collection IS NULL THEN 'Site' ELSE collection || ' | Site' END AS title, '/' || coalesce(collection || '/', '') AS link,
       strftime(newest, '%a, %d %b %Y %H:%M:%S +0000') AS lastBuildDate, 'Order ' || CAST(o_orderkey AS VARCHAR) AS item_title,
       strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS pubDate FROM x WHERE rn <= 10""")
def snk_03_collection(spark, d):
    o, c = table(spark, d, "orders"), F.col("collection")
    channels = SK.collection_feed(o, "Site", c, F.when(c.isNull(), "/").otherwise(F.concat(F.lit("/"), c, F.lit("/"))), "o_orderpriority", "o_orderdate", "o_orderkey", 10,
                                  F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")), F.col("o_orderstatus"))
    path = FS.new_path(spark, "collection")
    SK.write_channels(channels, path, "collection")
    back = (spark.read.format("xml").option("rowTag", "channel").schema(
        "title string, link string, description string, lastBuildDate string, item array<struct<title: string, pubDate: string>>, collection string").load(path))
    return back.select("collection", "title", "link", "lastBuildDate", F.explode("item").alias("x")) \
        .select("collection", "title", "link", "lastBuildDate", F.col("x.title").alias("item_title"), F.col("x.pubDate").alias("pubDate"))


@register("snk-05-event", """
SELECT o_orderkey, 'Event' AS kind, '/event/' || CAST(o_orderkey AS VARCHAR) AS page_id, CASE WHEN o_orderkey % 3 > 0 THEN c_name END AS place,
       CASE WHEN o_orderkey % 3 > 0 THEN c_mktsegment END AS locality, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS started,
       CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') END AS ended, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END AS performer
FROM orders JOIN customer ON o_custkey = c_custkey""")
def snk_05_event(spark, d):
    """Orders as events: a place with an address for some, an end for some, a performer for some."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, day = F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("timestamp")
    at = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")
    rec = SK.event_record(F.concat(F.lit("/event/"), key), F.concat(F.lit("Order "), key), F.when(F.col("o_orderkey") % 3 > 0, F.col("c_name")),
                          {"streetAddress": F.lit(None).cast("string"), "addressLocality": F.col("c_mktsegment")}, at(day),
                          F.when(F.col("o_orderstatus") == "F", at(day + F.expr("interval 1 day"))), F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")), F.lit("An order"))
    j = o.select("o_orderkey", rec.alias("j"))
    part = lambda p: F.get_json_object("j", p)
    return j.select("o_orderkey", part("$['@type']").alias("kind"), part("$.mainEntityOfPage['@id']").alias("page_id"), part("$.location.name").alias("place"),
                    part("$.location.address.addressLocality").alias("locality"), part("$.startDate").alias("started"), part("$.endDate").alias("ended"),
                    part("$.performer.name").alias("performer"))


@register("snk-05-site", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'WebSite' WHEN s_suppkey % 4 = 1 THEN 'LocalBusiness' ELSE 'Organization' END AS kind,
       'https://' || s_name || '/' AS url, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 4 = 1 THEN CAST(s_nationkey AS VARCHAR) || '.0' END AS latitude,
       CASE WHEN s_suppkey % 4 > 0 THEN n_name END AS country, CASE WHEN s_suppkey % 8 = 0 THEN 'https://' || s_name || '/?q={search_term_string}' END AS target
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def snk_05_site(spark, d):
    """Suppliers as sites: the record's type follows the page's."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, url = F.col("s_suppkey"), F.concat(F.lit("https://"), F.col("s_name"), F.lit("/"))
    local, where = k % 4 == 1, F.col("s_nationkey").cast("double")
    none = F.lit(None).cast("string")
    firm = SK.organization_record(F.when(local, "LocalBusiness").otherwise("Organization"), url, F.col("s_name"), F.concat(url, F.lit("logo.png")), none,
                                  F.when(local, where), F.when(local, -where), {"addressCountry": F.col("n_name")}, none)
    j = s.select("s_suppkey", F.when(k % 4 == 0, SK.website_record(url, k % 8 == 0)).otherwise(firm).alias("j"))
    part = lambda p: F.get_json_object("j", p)
    return j.select("s_suppkey", part("$['@type']").alias("kind"), part("$.url").alias("url"), part("$.name").alias("name"), part("$.geo.latitude").alias("latitude"),
                    part("$.address.addressCountry").alias("country"), part("$.potentialAction.target").alias("target"))
