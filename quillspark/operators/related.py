"""Related items (SEA-06): a top-k set-containment join by weighted keywords.

score(i, j) = 100 * (weight of i's keywords that j has) / (weight of i's keywords). Wanted are each item's ``k`` best others
with a score of the threshold or more, ties to smaller ids. Item pairs are never listed for their own sake:

* Keywords are numbered by rarity, rarest first. Items of one keyword set share a *signature*, named by its smallest id; its
  first k + 1 ids are all that can be among anyone's best.
* An item of up to ``FEW`` keywords asks by *subsets*: every subset of its keywords that reaches the threshold. If j is among
  i's best and shares the set S with it, then j is among the first k + 1 items that hold S: any k others of smaller ids that
  hold S would score as high and come before it. So a subset is answered by its first k + 1 signatures, cut in every task
  before the shuffle, however many items hold it: a keyword that all items share costs one short list. The largest weight of
  the subsets under which j is found is exactly what the two share.
* Signatures of up to ``FEW`` keywords are listed under their own subsets; larger ones meet a subset at its rarest keyword.
* A larger item asks by a *prefix*: its rarest keywords, just as many as weigh more than what may be missing. Keywords of one
  item count as missing from the start. Every row carries a *sketch*, ``64 * WORDS`` bits with one set for each keyword that
  others have: a bit that the partner's sketch lacks is at least one keyword that the partner lacks. So unrelated pairs that
  meet on a common word are dropped within the join, on bits alone, and never written. Keywords at places so far apart in the
  two rarity orders that too few can be shared before and after them do not meet either (position filter).
* The sketches of items of more than ``WIDE`` keywords are nearly full. Their prefix is longer by ``EXTRA`` of the heaviest
  keywords: what a partner shares of it weighs as much as the prefix less what may be missing, so their pairs are summed up
  over their meetings first, and only those that reach this go on.
* Pairs that have met are narrow rows. Of each item the ``TRIED * k`` that lack the fewest bits are scored on the whole sets.
  What lacks so many that it comes after the k-th best of these for certain is not scored, the rest is.
* Keyword lists of more than ``HOT`` signatures are dealt over as many shares; who asks for them asks every share.

Tables of a row a keyword or with whole sets are joined by sorting (``merge``): the size of their compressed files says little
of the rows that come of them, so a join planned by it would send gigabytes through the driver.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.windows import row_number_scaled
from quillspark.session import materialize

FEW, HOT, EXTRA = 8, 4096, 3
WORDS, WIDE, TRIED = 4, 128, 3
EPSILON = 1e-9


def _weight(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["w"])


def _sketch(entries: Column) -> list[Column]:
    """``WORDS`` numbers of 64 bits. The bit of a keyword is its number by rarity, so the most common ones do not share any."""
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(e["k"], F.lit(64)).cast("int"))
    here = lambda e, i: F.pmod(e["k"], F.lit(64 * WORDS)).between(64 * i, 64 * i + 63)
    return [F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: F.when(here(e, i), acc.bitwiseOR(bit(e))).otherwise(acc)).alias(f"bits_{i}") for i in range(WORDS)]


def _taken(weights: Column, limit: Column) -> Column:
    """(w, n): the sum and number of the first weights that reach the limit."""
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("n"), limit.alias("limit"))  # so that the limit is computed once
    more = lambda a, w: F.struct((a["w"] + w).alias("w"), (a["n"] + 1).alias("n"), a["limit"].alias("limit"))
    return F.aggregate(weights, start, lambda a, w: F.when(a["w"] >= a["limit"], a).otherwise(more(a, w)))


def _score(lost: Column) -> Column:
    """The score of a partner that lacks ``lost`` of the shared keywords, given as weights. They are summed up in one order, so
    that equal losses score the same and who lacks more, or heavier ones, never scores more."""
    return F.lit(100.0) * (F.col("own") - F.aggregate(F.array_sort(lost), F.col("lone"), lambda acc, w: acc + w)) / F.col("own")


def _may_lack(weights: Column) -> Column:
    """(better, equal): how many keywords a partner may lack at most to score more than ``least``, -1 if it cannot, and to score as much."""
    score = lambda w: F.lit(100.0) * (F.col("own") - w) / F.col("own")  # noqa: E731 - as in _score
    start = F.struct(F.col("lone").alias("w"), F.when(score(F.col("lone")) > F.col("least"), 0).otherwise(-1).alias("better"), F.lit(0).alias("equal"))
    more = lambda a, w: F.struct((a["w"] + w).alias("w"), (a["better"] + F.when(score(a["w"] + w) > F.col("least"), 1).otherwise(0)).alias("better"), (a["equal"] + 1).alias("equal"))
    return F.aggregate(F.array_sort(weights), start, lambda a, w: F.when(score(a["w"] + w) >= F.col("least"), more(a, w)).otherwise(a))


def _subsets(entries: Column, least: Column) -> Column:
    """Subsets of a short array, as (key, w), that weigh ``least`` or more; ``key`` has their numbers in order."""
    chosen = lambda mask: F.filter(entries, lambda e, i: F.getbit(mask, i) == 1)
    every = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size(entries)).cast("int") - 1), lambda m: chosen(m))
    found = F.transform(every, lambda s: F.struct(F.transform(s, lambda e: e["k"]).alias("key"), _weight(s).alias("w")))
    return F.filter(F.when(F.size(entries) > 0, found).otherwise(F.array()), lambda x: x["w"] >= least)


def numbered(keywords: DataFrame, id_col: str) -> DataFrame:
    """(_id, k, w, df): each item's distinct keywords with their number by rarity; ``df`` counts items. Missing and empty
    keywords, and missing indices, relate nothing."""
    kw = keywords.where((F.length("keyword") > 0) & F.col("index").isNotNull() & F.col(id_col).isNotNull())
    kw = kw.select(F.col(id_col).alias("_id"), F.struct("index", F.lower("keyword").alias("keyword")).alias("kw"), F.col("weight").cast("double").alias("w"))
    kw = materialize(kw.groupBy("_id", "kw").agg(F.max("w").alias("w")), "related-keywords")
    counts = kw.groupBy("kw").agg(F.count(F.lit(1)).alias("df"))
    ranks = row_number_scaled(counts, [F.col("df").asc(), F.col("kw").asc()], out="k")
    return kw.join(ranks, "kw").select("_id", "k", "w", "df")


def signatures(kw: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(sig, entries, own, heads, alone, lone, bits_0, ...) of every keyword set, and (_id, set) of every item. The first ``alone``
    of the entries are keywords of one item and weigh ``lone``; the others make the sketch. ``set`` names a set by the SHA-256 of
    its keywords and weights, as sorting by whole sets takes more time than all else."""
    items = kw.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("k", "w", "df"))).alias("entries"))
    named = F.concat_ws(",", F.transform("entries", lambda e: F.concat_ws(":", e["k"], e["w"])))
    items = materialize(items.withColumn("set", F.unhex(F.sha2(named, 256))), "related-items")
    first = F.row_number().over(Window.partitionBy("set").orderBy("_id"))
    sigs = (items.withColumn("_r", first).where(F.col("_r") <= k + 1).groupBy("set")
            .agg(F.array_sort(F.collect_list("_id")).alias("heads"), F.first("entries").alias("entries")))
    sigs = sigs.withColumn("_shared", F.filter("entries", lambda e: e["df"] > 1)).select(
        F.col("heads")[0].alias("sig"), "entries", _weight(F.col("entries")).alias("own"), "heads", "set", (F.size("entries") - F.size("_shared")).alias("alone"),
        _weight(F.filter("entries", lambda e: e["df"] == 1)).alias("lone"), *_sketch(F.col("_shared")))
    return materialize(sigs, "related-signatures"), items.select("_id", "set")


def _dealt(lists: DataFrame, asks: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` with a ``share``: rows of a key that lists more than ``HOT`` are dealt by ``by``, and its
    askers repeated for every share. ``df`` is the length of the key's list on both sides."""
    shares = F.ceil(F.col("df") / F.lit(HOT)).cast("int")
    lists = lists.withColumn("share", F.pmod(F.xxhash64(by), shares).cast("int"))
    return lists, asks.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k + 1`` signatures of each subset."""
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("sig"))).where(F.col("_r") <= k + 1).select("key", "sig")


def _by_subsets(sigs: DataFrame, share: float, k: int) -> DataFrame:
    """(sig_a, sig_b, score) for the signatures of few keywords."""
    need = F.col("own") * F.lit(share) - F.lit(EPSILON)
    common = F.filter("entries", lambda e: e["df"] > 1)  # a keyword of one item is shared with nobody
    few = sigs.where(F.size("entries") <= FEW)
    asks = materialize(few.select("sig", "own", F.explode(_subsets(common, need)).alias("s")).select("sig", "own", "s.key", "s.w"), "related-asked")
    keys = materialize(asks.select("key").distinct(), "related-subsets")
    least = keys.agg(F.coalesce(F.min(F.size("key")), F.lit(1))).scalar()
    own = few.select("sig", F.explode(_subsets(common, F.lit(0.0))).alias("s")).select("sig", "s.key").where(F.size("key") >= least)
    small = _first(own.join(keys.hint("merge"), "key", "left_semi"), k)
    # of the larger sets only the keywords that some subset has
    words = keys.select(F.posexplode("key").alias("place", "k")).groupBy("k").agg((F.min("place") == 0).alias("rarest"))
    large = sigs.where(F.size("entries") > FEW).select("sig", F.explode("entries").alias("e")).select("sig", "e.k", "e.df")
    large = large.join(words.hint("merge"), "k").groupBy("sig").agg(F.collect_list(F.struct("k", "df", "rarest")).alias("entries"))
    large = materialize(large, "related-asked-of")
    lists = large.select("sig", F.transform("entries", lambda e: e["k"]).alias("ks"), F.explode(F.filter("entries", lambda e: e["rarest"])).alias("e"))
    lists = lists.select("sig", F.col("e.k").alias("at"), F.col("e.df").alias("df"), "ks")
    lengths = lists.groupBy("at").agg(F.max("df").alias("df"))
    asked = keys.withColumn("at", F.element_at("key", 1)).join(lengths.hint("merge"), "at")
    lists, asked = _dealt(lists, asked, "at", "sig")
    met = lists.drop("df").join(asked.drop("df").hint("merge"), ["at", "share"]).where(F.size(F.array_except("key", "ks")) == 0).select("key", "sig")
    found = _first(small.unionByName(_first(met, k)), k).withColumnRenamed("sig", "sig_b")
    pairs = asks.join(found.hint("merge"), "key").where(F.col("sig") != F.col("sig_b"))
    return pairs.groupBy(F.col("sig").alias("sig_a"), "sig_b").agg((F.lit(100.0) * F.max("w") / F.first("own")).alias("score"))


def _shared(entries: str, n: Column | None = None) -> Column:
    """Of a column of the entries or of one of their fields, what is of keywords of more than one item, the first ``n``."""
    return F.slice(entries, F.col("alone") + 1, F.size("entries") - F.col("alone") if n is None else n)


def _met(sigs: DataFrame, share: float) -> DataFrame:
    """(sig_a, sig_b, lacks): the pairs that may reach the threshold, for signatures of more keywords; sig_b lacks as many of
    sig_a's keywords, or more."""
    need = F.col("own") * F.lit(share) - F.lit(EPSILON)
    bits = [f"bits_{i}" for i in range(WORDS)]
    n = F.size("entries") - F.col("alone")
    # the fewest keywords that reach the threshold, the prefix, and what a partner shares of it at least
    loss, weights = F.col("own") - F.col("lone") - need, _shared("entries.w")
    more = F.when(n > WIDE, F.lit(float(EXTRA)) * F.array_max(weights)).otherwise(0.0)
    large = (sigs.where((F.size("entries") > FEW) & (loss >= 0)).withColumn("enough", _taken(F.reverse(F.array_sort(weights)), need)["n"])
             .withColumn("prefix", _taken(weights, loss + F.lit(EPSILON) + more)))
    asks = (large.select("sig", "enough", (F.col("prefix.w") - loss - F.lit(EPSILON)).alias("shares"), n.alias("n"), *bits,
                         F.posexplode(_shared("entries", F.col("prefix.n"))).alias("place", "e"))
            .select(F.col("sig").alias("sig_a"), "enough", "shares", F.col("place").alias("place_a"), F.col("n").alias("n_a"),
                    F.col("e.w").alias("w"), F.col("e.k").alias("at"), F.col("e.df").alias("df"), *[F.col(x).alias(f"{x}_a") for x in bits]))
    lists = (sigs.select("sig", n.alias("n"), *bits, F.posexplode(_shared("entries")).alias("place", "e"))
             .select(F.col("sig").alias("sig_b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("e.k").alias("at"), F.col("e.df").alias("df"),
                     *[F.col(x).alias(f"{x}_b") for x in bits]))
    lists, asks = _dealt(lists, asks, "at", "sig_b")
    most = F.least("place_a", "place_b") + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    lacks = reduce(operator.add, [F.bit_count(F.col(f"{x}_a").bitwiseAND(F.bitwise_not(f"{x}_b"))) for x in bits])
    met = (asks.drop("df").join(lists.drop("df").hint("merge"), ["at", "share"])
           .where((most >= F.col("enough")) & (lacks <= F.col("n_a") - F.col("enough")) & (F.col("sig_a") != F.col("sig_b"))))
    met = met.groupBy("sig_a", "sig_b").agg(F.sum("w").alias("w"), F.first("shares").alias("shares"), F.first(lacks).alias("lacks"))
    return met.where(F.col("w") >= F.col("shares")).select("sig_a", "sig_b", "lacks")


def _scored(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs with their score on the whole sets."""
    whole = sigs.select(F.col("sig").alias("sig_a"), _shared("entries.k").alias("ks_a"), _shared("entries.w").alias("ws_a"), "own", "lone")
    held = sigs.select(F.col("sig").alias("sig_b"), _shared("entries.k").alias("ks_b"))
    both = pairs.join(held.hint("merge"), "sig_b").join(whole.hint("merge"), "sig_a").withColumn("lost", F.array_except("ks_a", "ks_b"))
    lost = F.transform("lost", lambda k: F.element_at(F.col("ws_a"), F.array_position("ks_a", k).cast("int")))
    return both.select(*pairs.columns, _score(lost).alias("score"))


def _by_prefix(sigs: DataFrame, share: float, k: int = 5) -> DataFrame:
    """(sig_a, sig_b, score) for the signatures of more keywords: all that can be among the first k of sig_a."""
    met = materialize(_met(sigs, share), "related-met")
    order = Window.partitionBy("sig_a").orderBy("lacks", "sig_b")
    tried = met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= TRIED * k).drop("_r")
    tried = materialize(_scored(tried, sigs), "related-tried")
    # the k-th best so far; what comes after it for certain need not be scored
    best = F.get(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "sig_b"))), F.lit(k - 1))
    ends = tried.groupBy("sig_a").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("lacks", "sig_b")).alias("last"), best.alias("best")).where(F.col("n") == TRIED * k)
    ends = ends.select("sig_a", "last", F.col("best.sig_b").alias("first"), (-F.col("best.minus")).alias("least"))
    ends = ends.join(sigs.withColumnRenamed("sig", "sig_a").hint("merge"), "sig_a").select("sig_a", "last", "first", _may_lack(_shared("entries.w")).alias("may"))
    rest = met.join(ends.hint("merge"), "sig_a").where(F.struct("lacks", "sig_b") > F.col("last"))
    rest = rest.where((F.col("lacks") <= F.col("may.better")) | ((F.col("lacks") <= F.col("may.equal")) & (F.col("sig_b") < F.col("first"))))
    return tried.drop("lacks").unionByName(_scored(rest.select("sig_a", "sig_b"), sigs))


def related(id_col: str, keywords: DataFrame, threshold: float = 80.0, k: int = 5) -> DataFrame:
    """SEA-06: for each item its ``k`` best related items, as (``id_col``, related_id, rank, score).

    ``keywords`` has (id, index, keyword, weight): keywords are compared within an index, ignoring case. Rows with a null or
    empty keyword, a null index or a null id take no part; a keyword given twice counts once, by its larger weight."""
    share = threshold / 100.0
    sigs, items = signatures(numbered(keywords, id_col), k)
    same = sigs.where(F.size("heads") > 1).select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"), F.lit(100.0).alias("score"))
    found = _by_subsets(sigs, share, k).unionByName(_by_prefix(sigs, share, k)).unionByName(same).where(F.col("score") >= F.lit(threshold))
    # of each signature's partners, the first k + 1 items by score and id hold all that its own items can need
    lists = sigs.select(F.col("sig").alias("sig_b"), "heads")
    near = found.join(lists.hint("merge"), "sig_b").select("sig_a", "score", F.explode("heads").alias("related_id"))
    order = Window.partitionBy("sig_a").orderBy(F.col("score").desc(), "related_id")
    near = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    names = items.join(sigs.select("set", "sig").hint("merge"), "set").select(F.col("_id").alias(id_col), F.col("sig").alias("sig_a"))
    out = names.join(near.hint("merge"), "sig_a").where(F.col(id_col) != F.col("related_id"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("score").desc(), "related_id"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(id_col, "related_id", F.col("rank").cast("bigint").alias("rank"), "score")
