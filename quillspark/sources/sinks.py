"""Sinks: search-corpus JSON (SNK-02), per-term feeds (SNK-03) and
linked-data records (SNK-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.dates import RFC822, fmt


def write_corpus(corpus: DataFrame, path: str) -> None:
    """SNK-02: one JSON document per line (splittable, unlike one array)."""
    corpus.write.mode("overwrite").json(path)


def feed_items(df: DataFrame, term: str, date_col: str, id_col: str, n: int, title: Column,
               link: Column) -> DataFrame:
    """SNK-03: newest ``n`` items per term with RSS fields. ``row_number <= n``
    is cut per task before the shuffle (window group limit)."""
    w = Window.partitionBy(term).orderBy(F.col(date_col).desc(), F.col(id_col).desc())
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.select(term, title.alias("title"), link.alias("link"), link.alias("guid"),
                      fmt(date_col, RFC822).alias("pubDate"))


def write_feeds(items: DataFrame, path: str, term: str) -> None:
    """SNK-03: one XML feed per term (``item`` rows under ``channel``)."""
    (items.repartition(term).write.mode("overwrite").partitionBy(term).format("xml")
          .option("rowTag", "item").option("rootTag", "channel").save(path))


def jsonld(kind: Column, fields: dict[str, Column]) -> Column:
    """SNK-05: a schema.org record whose ``@type`` follows the page type;
    null members are left out of the JSON."""
    rec = F.struct(F.lit("https://schema.org").alias("@context"), kind.alias("@type"),
                   *[v.alias(k) for k, v in fields.items()])
    return F.to_json(rec)


def feed_channels(items: DataFrame, term: str, title: Column, link: Column, description: Column, date_col: str = "date") -> DataFrame:
    """SNK-03: one channel per term with its own title, link, description and build date (that of the newest item), and
    its items, newest first (``feed_items`` bounds them). ``items`` has ``rank`` and ``date_col`` besides the item fields."""
    fields = [c for c in ("title", "link", "guid", "pubDate", "description") if c in items.columns]
    return (items.groupBy(term).agg(F.max(date_col).alias("_last"), F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("_items"))
            .select(term, title.alias("title"), link.alias("link"), description.alias("description"), fmt("_last", RFC822).alias("lastBuildDate"),
                    F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("item")))


def write_channels(channels: DataFrame, path: str, term: str) -> None:
    """SNK-03: one feed document per term: an ``rss`` root, one ``channel``, its items inside."""
    channels.repartition(term).write.mode("overwrite").partitionBy(term).format("xml").option("rowTag", "channel").option("rootTag", "rss").save(path)


def _typed(kind: str, **members: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *[v.alias(k) for k, v in members.items()])


def article_record(is_post: Column, link: Column, headline: Column, published: Column, modified: Column, author: Column,
                   publisher: str, logo: str, description: Column) -> Column:
    """SNK-05: an Article or BlogPosting with its nested page, author, publisher and logo; an author that is missing is left out."""
    return jsonld(F.when(is_post, "BlogPosting").otherwise("Article"), {
        "mainEntityOfPage": F.struct(F.lit("WebPage").alias("@type"), link.alias("@id")), "headline": headline,
        "datePublished": published, "dateModified": modified, "author": F.when(author.isNotNull(), _typed("Person", name=author)),
        "publisher": _typed("Organization", name=F.lit(publisher), logo=_typed("ImageObject", url=F.lit(logo))), "description": description})


def event_record(link: Column, name: Column, place: Column, address: dict[str, Column] | None, start: Column, end: Column,
                 performer: Column, description: Column) -> Column:
    """SNK-05: an Event; place, end and performer are left out where missing."""
    parts = {} if address is None else {"address": _typed("PostalAddress", **{k: F.coalesce(v, F.lit("")) for k, v in address.items()})}
    return jsonld(F.lit("Event"), {
        "mainEntityOfPage": F.struct(F.lit("WebPage").alias("@type"), link.alias("@id")), "name": name,
        "location": F.when(place.isNotNull(), _typed("Place", name=place, **parts)), "startDate": start, "endDate": end,
        "performer": F.when(performer.isNotNull(), _typed("Person", name=performer)), "description": description})


def organization_record(kind: Column, url: Column, name: Column, logo: Column, image: Column, latitude: Column, longitude: Column,
                        address: dict[str, Column] | None, phone: Column) -> Column:
    """SNK-05: the publisher's own record, of the site's type; place, address, image and phone are left out where missing."""
    place = F.when(latitude.isNotNull() & longitude.isNotNull(), _typed("GeoCoordinates", latitude=latitude, longitude=longitude))
    parts = {} if address is None else {"address": _typed("PostalAddress", **{k: F.coalesce(v, F.lit("")) for k, v in address.items()})}
    return jsonld(kind, {"@id": url, "name": name, "logo": logo, "image": image, "geo": place, **parts, "telephone": phone, "url": url})


def website_record(url: Column, searchable: Column) -> Column:
    """SNK-05: a WebSite, with its search action where it can be searched."""
    action = _typed("SearchAction", **{"target": F.concat(url, F.lit("?q={search_term_string}")), "query-input": F.lit("required name=search_term_string")})
    return jsonld(F.lit("WebSite"), {"potentialAction": F.when(searchable, action), "url": url})


def collection_feed(pages: DataFrame, site: str, title: Column, link: Column, section: str, date_col: str, id_col: str, n: int,
                    item_title: Column, item_link: Column, description: Column) -> DataFrame:
    """SNK-03: one feed per collection (a section; the site's own, under a null section, holds all pages): its title, link,
    build date and newest ``n`` pages. Every page belongs to its section and to the site, and each is cut to ``n`` in every
    task before the shuffle, so the site's feed never meets in one task."""
    both = pages.select("*", F.explode(F.array_distinct(F.array(F.col(section), F.lit(None)))).alias("_to"))
    w = Window.partitionBy("_to").orderBy(F.col(date_col).desc(), F.col(id_col).desc())
    top = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    items = top.select(F.col("_to").alias("collection"), "rank", F.col(date_col).alias("date"), item_title.alias("title"), item_link.alias("link"),
                       item_link.alias("guid"), fmt(date_col, RFC822).alias("pubDate"), description.alias("description"))
    name = F.col("collection")
    full = F.when(name.isNull(), F.lit(site)).otherwise(F.concat(title, F.lit(f" | {site}")))
    return feed_channels(items, "collection", full, link, F.coalesce(title, F.lit(site)))
