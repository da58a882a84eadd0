"""Mixing sources to target weights by hierarchical budgeting.

Leaves hang in a tree of domain, language and source. A budget of tokens enters at the root and is dealt at each node
to its children by their weights. No child gets more than its subtree can give, which is ``epochs`` times its
tokens; what it cannot use goes to its siblings, by their weights, and only what a whole subtree cannot use
goes on to the siblings of its ancestors. (Filling children up to one level of budget per weight does just that, as a
child's limit is what its whole subtree holds.)

A leaf's budget is a prefix of its seeded epochs: epoch e has the leaf's documents in the order of md5(seed:e:id). Epochs
that fit are taken whole; of the next one, documents are taken in order as long as the tokens before them are below
the rest of the budget, so a leaf passes its budget by less than one document.

No leaf's documents meet in one task: tokens are summed by (leaf, first three hex digits of the order key), which
finds the 4096th of the epoch where the budget ends; only the documents there are put in order. What remains of a leaf is
one threshold, so choosing is a join with the leaves' table.

Tokens are counted by ``tokens``, a column expression. A null domain, language or source is a value of its own (the
empty name); a missing weight is ``other``; weights of 0 take nothing. Rows with equal ids share their order key and
are taken or left together; null ids count as one id, the empty one. A null or empty text has no tokens and is taken with
what stands before it; a very long text is taken or left whole. Repeated rows are taken as often as they stand there. An empty
table gives no rows. The input's columns come back in one struct, ``row``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import small_side, written

LEVELS = ("domain", "lang", "source")


def _weight(level: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to the children of each node, from ``given`` (the node's), ``cap`` and ``weight``: children in the
    order of cap per weight are filled while the level their siblings would get reaches their cap."""
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.where("weight > 0")
    level = (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    open_ = F.col("cap") > F.col("__level") * F.col("weight")
    nodes = nodes.withColumn("__level", level).withColumn("__open", F.when(open_, F.col("__level")))
    nodes = nodes.withColumn("__level", F.first("__open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.least(F.col("cap").cast("double"), F.col("__level") * F.col("weight"))
    return nodes.withColumn("budget", F.greatest(F.coalesce(share, F.col("cap").cast("double")), F.lit(0.0))).drop("__level", "__open")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: float, epochs: int, other: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with each leaf's ``budget``, never above ``epochs`` times its tokens.
    The windows run over the leaves' table, a row a source, not over documents."""
    given = leaves.select(F.lit(float(budget)).alias("given")).limit(1)
    parent: list[str] = []
    for level in LEVELS:
        sums = leaves.groupBy(*parent, level).agg((F.sum("tokens") * epochs).alias("cap")).withColumn("weight", _weight(level, weights.get(level, {}), other))
        nodes = sums.withColumn("given", F.lit(float(budget))) if not parent else sums.join(given, parent)
        if not parent:
            nodes, parent_keys = nodes.withColumn("__root", F.lit(0)), ["__root"]
        else:
            parent_keys = parent
        parent = [*parent, level]
        given = _deal(nodes, parent_keys, level).select(*parent, F.col("budget").alias("given"))
    return leaves.join(given, list(LEVELS), "left").withColumn("budget", F.coalesce("given", F.lit(0.0))).drop("given")


def _named(docs: DataFrame, key: str, domain: Column, lang: str, source: str, tokens: Column) -> DataFrame:
    clean = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), clean(F.col(key)).alias("__id"), clean(domain).alias("domain"),
                       clean(F.col(lang)).alias("lang"), clean(F.col(source)).alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def mix(docs: DataFrame, domain: Column, tokens: Column, weights: dict[str, dict[str, int]], share: float, epochs: int, seed: int,
        key: str = "doc_id", lang: str = "lang", source: str = "source", other: int = 1) -> DataFrame:
    """The rows taken: (``row`` with the input's columns, domain, lang, source, tokens, ``epoch`` from 0, the leaf's
    ``budget``). The budget in all is ``share`` of the table's tokens."""
    named = _named(docs, key, domain, lang, source, tokens)
    narrow = written(named.select("__id", *LEVELS, "tokens"), "tokens")
    leaves = written(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    n_leaves = leaves.count()
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    ends = budgets(leaves, weights, float(int(total * share)), epochs, other)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.when(F.col("budget") >= 0, F.lit(0)))
    ends = written(ends.withColumn("whole", whole.cast("int"))
                   .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
                   .withColumnRenamed("tokens", "leaf_tokens"), "ends")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("__id")).cast("binary"))
    width = 512
    keyed = narrow.join(small_side(ends.where("rest > 0").select(*LEVELS, "whole", "rest"), n_leaves, width), list(LEVELS)).withColumn("order", order)
    cut = F.substring("order", 1, 3)
    sums = written(keyed.groupBy(*LEVELS, cut.alias("cut")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest")), "cuts")
    running = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = Window.partitionBy(*LEVELS).orderBy(F.desc("cut"))  # the last 4096th that starts below the rest
    ending = (sums.withColumn("before", running).where(F.col("before") < F.col("rest"))
              .withColumn("__k", F.row_number().over(last)).where("__k = 1").select(*LEVELS, "cut", "before"))
    near = keyed.withColumn("cut", cut).join(small_side(ending, n_leaves, width), [*LEVELS, "cut"])
    inside = F.col("before") + F.coalesce(F.sum("tokens").over(
        Window.partitionBy(*LEVELS).orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.col("same")
    same = F.sum("tokens").over(Window.partitionBy(*LEVELS, "order"))
    limit = (near.withColumn("same", same).withColumn("at", inside).where(F.col("at") < F.col("rest"))
             .groupBy(*LEVELS).agg(F.max("order").alias("last")))
    table = written(ends.join(limit, list(LEVELS), "left").select(*LEVELS, "whole", "budget", "last"), "limits")
    taken = named.join(small_side(table, n_leaves, width), list(LEVELS))
    times = F.col("whole") + F.coalesce((order <= F.col("last")).cast("int"), F.lit(0))
    taken = taken.withColumn("__times", times).where("__times > 0")
    return taken.select("row", *LEVELS, "tokens", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch"), "budget")


def whitespace_tokens(text: Column) -> Column:
    """A cheap token count of whole texts: stretches of characters other than white space, by the gaps between them."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.char_length(F.regexp_replace(words, r"[\x20\x09-\x0D]+", ""))


def domain_of(source: Column, domains: int = 4) -> Column:
    """For tables without a domain: sources dealt over ``domains`` domains by a hash of their name."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("d"), F.pmod(digit, F.lit(domains)).cast("string"))
