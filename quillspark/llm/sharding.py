"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards, each shard with a weight; a rack weighs what its shards weigh, a region what
its racks weigh. A row descends the tree: at each level every child draws ``-ln(u) / weight`` with ``u`` a uniform
hash of (key, level, child), and the smallest draw wins, so a child wins with probability weight / sum of weights.
A child's draw depends on that child alone. Raising its weight can only turn other rows towards it, lowering it can
only send its own rows away: between two subtrees whose weights stay as they are, no row moves.

Rules for odd rows: a null key is hashed as a key of its own, so all such rows share a shard (their slots are still
dealt over the input's partitions); rows that repeat get a slot each; an empty table gives no rows; a null text has
no bytes (size 1, CRC of the empty text); a very long text is only measured and summed (its size is its own, its shard the
key's); equal draws go to the smaller child. Other columns of the input are left alone: working columns carry a ``__``
prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import text_of, written


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = 16, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Shards 0 to ``shards`` - 1 of equal weight: the first ``base`` in racks of ``per_rack`` and regions of ``racks``
    racks; each later shard opens a region of its own. So beyond ``base`` a new shard leaves all other subtrees'
    weights as they are, and takes rows only into itself."""
    out = []
    for s in range(shards):
        rack = s // per_rack if s < base else -(-base // per_rack) + s - base
        region = rack // racks if s < base else -(-base // (per_rack * racks)) + s - base
        out.append(Shard(region, rack, s))
    return out


def _children(nodes: dict[int, float]) -> str:
    return "array(" + ", ".join(f"named_struct('id', {i}, 'w', {w!r}D)" for i, w in sorted(nodes.items())) + ")"


def _winner(key: Column, level: int, children: Column) -> Column:
    """Id of the child with the smallest weighted draw; equal draws go to the smaller id."""
    def draw(c):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), c["id"]), 11)
        return F.struct((-F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / c["w"]).alias("draw"), c["id"].alias("id"))
    return F.array_min(F.transform(children, draw))["id"]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of ``key`` in ``tree``: three draws, one level after the other."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard with a positive weight")
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for s in live:
        regions.setdefault(s.region, {}).setdefault(s.rack, {})[s.shard] = s.weight
    rack_ids = [k for r in regions.values() for k in r]
    if len(rack_ids) != len(set(rack_ids)) or len(live) != len({s.shard for s in live}):
        raise ValueError("a rack belongs to one region and a shard to one rack")
    weight = {k: sum(v.values()) for r in regions.values() for k, v in r.items()}
    region = _winner(key, 1, F.expr(_children({r: sum(weight[k] for k in ks) for r, ks in regions.items()})))
    racks = F.expr("map(" + ", ".join(f"{r}, {_children({k: weight[k] for k in ks})}" for r, ks in regions.items()) + ")")
    shards = F.expr("map(" + ", ".join(f"{k}, {_children(s)}" for r in regions.values() for k, s in r.items()) + ")")
    return _winner(key, 3, F.element_at(shards, _winner(key, 2, F.element_at(racks, region))))


def slots(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard. Rows are numbered within (shard, input partition) and moved by
    the rows of that shard in earlier partitions, so no shard's rows meet in one task. ``df`` is written once: its
    partitions are then fixed, whatever is recomputed."""
    tagged = written(df.withColumn("__part", F.spark_partition_id()), "slots")
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (tagged.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
             .select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__base")))
    own = Window.partitionBy(shard, "__part").orderBy(*order)
    return (tagged.withColumn("__pos", F.row_number().over(own) - 1)
            .join(bases, [shard, "__part"])
            .withColumn("slot", F.col("__base") + F.col("__pos")).drop("__part", "__pos", "__base"))


def shard_table(df: DataFrame, key: str, text: str, tree: list[Shard], grown: list[Shard] | None = None) -> DataFrame:
    """Per row: key, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard``, ``grown_shard`` (its shard in ``grown``,
    else null) and ``slot``. One pass over the texts; only these narrow columns are written and shuffled."""
    doc = text_of(text)
    narrow = df.select(
        F.col(key).alias(key), (F.octet_length(doc) + 1).cast("long").alias("size"),
        F.crc32(doc.cast("binary")).alias("text_crc32"), shard_of(F.col(key), tree).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    return slots(narrow, "shard", [key, "text_crc32", "size"])
