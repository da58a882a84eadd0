"""E1 listing on ``orders``: the minimum end-to-end slice."""

from pyspark.sql import functions as F

from quillspark.operators.listing import ListingSpec, listing
from quillspark.plans.registry import register
from quillspark.plans.tables import table

FLAGSHIP_SPEC = ListingSpec(filters={"o_orderstatus": "F"}, exclude_future=True,
                            order="desc", offset=5, count=10)
AS_OF = "2000-01-01 00:00:00"


def flagship(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = listing(orders, FLAGSHIP_SPEC, date_col="o_orderdate", id_col="o_orderkey",
                  as_of=AS_OF)
    return out.select("o_orderkey", "o_custkey", "o_orderdate",
                      F.round("o_totalprice", 2).alias("o_totalprice"), "total", "more")


register("e1-listing", """
SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice, total, total > 10 AS more
FROM (SELECT *, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'
                 AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00') AS total
      FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00'
      ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 5)
""")(flagship)


@register("e1-listing-all", """
SELECT l_orderkey, l_linenumber, CAST(count(*) OVER () AS BIGINT) AS total, false AS more FROM lineitem""")
def listing_all(spark, sf_dir):
    out = listing(table(spark, sf_dir, "lineitem"), ListingSpec(count=0), date_col="l_shipdate", id_col="l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "total", "more")
