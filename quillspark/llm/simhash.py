"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most t bits, with the 64 bits split into m parts, differ in at most t_i bits on some part
i whenever the t_i add up to t - m + 1 (a part with -1 is never looked at). The parts need not be alike: bits that
go together are grouped into one part, so that the parts are as independent as can be, and the t_i come from dynamic
programming over the probes and the estimated candidates that each threshold costs. m itself is the cheapest of 2
to t + 1. All fingerprints with a part within its t_i then meet in one place: each sends its own value of the part and
every value within t_i flips of it; rows of one value are compared bit by bit.

Estimates come from a planning sample of at most ``SAMPLE`` fingerprints, chosen by hash. They only choose the parts;
the search covers every fingerprint, and its result does not depend on them.

Equal fingerprints are one row of the search. A value that ``DENSE`` rows or more share gives a spanning forest of its
links, not all pairs, which leaves the components as they are; a value with more than ``BLOCK`` fingerprints of its own
is dealt over several tasks, each with a share of these against everything that probes them.

A null text counts as empty; a text without words has the fingerprint 0, which links like any other. Very long texts are
hashed whole, a slice of rows at a time. Ties (several rows of the smallest key) and repeated rows: see ``near_duplicates`` and
``deduplicated``. An empty table gives no rows. Only key and text are read; other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import by_value, hash_sample, packed, slices, small_side, text_of, unpacked, written

by_value(__name__)

BITS, SAMPLE, DENSE, BLOCK = 64, 1 << 16, 32, 20_000
#: Cost of comparing one candidate, in rows probed.
COMPARE = 0.05


def fingerprint(raw: bytes, shingle: int) -> int:
    """SimHash of one text, as a signed 64-bit number; no words: 0."""
    import xxhash
    words = raw.lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, ``fp`` long) of every row; a null text counts as empty."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], pa.int64())], [key, "fp"])
    rows = docs.select(F.col(key), text_of(text).cast("binary").alias("__bytes"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size: each starts at the bit with the most correlation left and takes the bit that is most
    correlated with it, until it is full."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits * bits).sum(axis=0)) + 1e-9
    corr = np.abs((bits / scale).T @ (bits / scale))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(best := max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(best)
        out.append(sorted(group))
    return out


def candidates(sample: np.ndarray, part: list[int], most: int, total: int) -> list[float]:
    """Estimated pairs of ``total`` fingerprints within 0..``most`` flips on a part: equal values counted in the sample,
    then scaled by how often independent bits of these frequencies differ."""
    mask = np.uint64(sum(1 << b for b in part))
    n = max(2, len(sample))
    same = sum(c * (c - 1) / 2 for c in np.unique(sample & mask, return_counts=True)[1].tolist())
    p = [float(((sample >> np.uint64(b)) & np.uint64(1)).mean()) for b in part]
    dist = [1.0] + [0.0] * most  # of the number of bits in which two fingerprints differ
    for x in p:
        d = 2 * x * (1 - x)
        dist = [dist[e] * (1 - d) + (dist[e - 1] * d if e else 0.0) for e in range(most + 1)]
    equal = max(same / (n * (n - 1) / 2), dist[0])
    return [equal * sum(dist[: e + 1]) / max(dist[0], 1e-30) * total * total / 2 for e in range(most + 1)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Least total cost, and a threshold of -1 or more for each part, the thresholds adding up to ``budget``.
    ``costs[i][e + 1]`` is what threshold e costs on part i."""
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for e in range(-1, len(cost) - 1):
                new = (c + cost[e + 1], [*chosen, e])
                if used + e not in step or new < step[used + e]:
                    step[used + e] = new
        best = step
    return best[budget]


def plan(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """The parts to be searched with their thresholds."""
    options = []
    for m in range(2, distance + 2):
        parts, most = group_bits(sample, m), distance - m + 1
        costs = []
        for part in parts:
            near = candidates(sample, part, most + m - 1, total)
            costs.append([0.0] + [total * sum(math.comb(len(part), j) for j in range(e + 1)) + COMPARE * near[e] for e in range(most + m)])
        cost, chosen = allocate(costs, most)
        options.append((cost, [(p, e) for p, e in zip(parts, chosen) if e >= 0]))
    return min(options)[1] if distance else [(list(range(BITS)), 0)]


def _flips(part: list[int], most: int) -> np.ndarray:
    """Masks that flip 1 to ``most`` bits of the part."""
    masks, layer = [], [(0, 0)]
    for _ in range(most):
        layer = [(m | 1 << part[i], i + 1) for m, at in layer for i in range(at, len(part))]
        masks += [m for m, _ in layer]
    return np.array(masks, dtype=np.uint64)


def _probes(parts):
    """Rows (part, key, probe, fp): each fingerprint's own value of every part, and the values near it."""
    plan_ = [(k, np.uint64(sum(1 << b for b in part)), _flips(part, e)) for k, (part, e) in enumerate(parts)]

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 4096):
                fp = fps[i : i + 4096]
                for k, mask, flips in plan_:
                    own = fp & mask
                    for probe, key, who in ((False, own, fp), (True, (own[:, None] ^ flips).ravel(), np.repeat(fp, len(flips)))):
                        if len(key):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(key), probe)), pa.array(who.view(np.int64))], ["part", "key", "probe", "fp"])
    return run


def _forest(own: np.ndarray, probes: np.ndarray, distance: int):
    """Links that connect what the links between ``own`` and everything connect: each fingerprint reached is taken out and
    compared with those not reached yet."""
    links = []
    while len(own):
        todo, own = [own[0]], own[1:]
        while todo:
            x = todo.pop()
            for which in (0, 1):
                rest = probes if which else own
                near = np.bitwise_count(rest ^ x) <= distance
                if near.any():
                    links += [(x, y) for y in rest[near]]
                    todo += list(rest[near])
                    if which:
                        probes = rest[~near]
                    else:
                        own = rest[~near]
    return links


def _links(distance: int):
    """From rows sorted by (part, key, block, probe): verified links (a, b) with a before b."""

    def solve(start, own, fp):
        """start: of each group of equal keys; own: its first rows that hold the key as their own."""
        size = np.diff(np.append(start, len(fp)))
        use = (own > 0) & (size > 1)
        a, b = [], []
        small = np.flatnonzero(use & (size <= DENSE))
        for i in range(0, len(small), 1 << 12):
            g = small[i : i + (1 << 12)]
            pairs = own[g] * size[g]
            at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            x = fp[np.repeat(start[g], pairs) + at // np.repeat(size[g], pairs)]
            y = fp[np.repeat(start[g], pairs) + at % np.repeat(size[g], pairs)]
            near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
            a.append(x[near])
            b.append(y[near])
        for g in np.flatnonzero(use & (size > DENSE)):
            rows = fp[start[g] : start[g] + size[g]]
            if links := _forest(rows[: own[g]], rows[own[g] :], distance):
                x, y = np.array(links, dtype=np.uint64).T
                a.append(x[x != y])
                b.append(y[x != y])
        x, y = (np.concatenate(v) if v else np.zeros(0, dtype=np.uint64) for v in (a, b))
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(5)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            part, key, block, probe, fp = held
            if not len(fp):
                continue
            first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            if len(first) > 1:  # the last key may go on in the next batch
                end = first[-1]
                yield solve(first[:-1], np.add.reduceat(~probe[:end], first[:-1], dtype=np.int64), fp[:end].view(np.uint64))
                held = [x[end:] for x in held]
        if held is not None and len(held[4]):
            yield solve(np.zeros(1, dtype=np.int64), np.array([(~held[3]).sum()]), held[4].view(np.uint64))
    return run


def links(fps: DataFrame, total: int, distance: int) -> DataFrame:
    """Links (a, b) between different fingerprints of the column ``fp`` (``total`` different ones, each once), enough to
    connect all that are linked by ``distance`` bits or fewer."""
    spark = fps.sparkSession
    rows = hash_sample(fps, "fp", SAMPLE, total, 7).limit(2 * SAMPLE).collect()
    if total < 2 or not rows:
        return spark.createDataFrame([], "a long, b long")
    parts = plan(np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64), total, distance)
    probes = fps.select("fp").mapInArrow(_probes(parts), "part int, key long, probe boolean, fp long")
    masks = F.array(*[F.lit(int(np.array(sum(1 << b for b in part), dtype=np.uint64).view(np.int64))) for part, _ in parts])
    hot = written(fps.select(F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "key"))
                  .groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
                  .select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    if n_hot := hot.count():
        probes = probes.join(small_side(hot, n_hot, 32), ["part", "key"], "left")
        share = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        own = F.transform(every, lambda b: F.struct(b.alias("block"), (F.col("probe") | (b != share)).alias("probe")))
        probes = probes.select("part", "key", "fp", F.explode(own).alias("x")).select("part", "key", "x.block", "x.probe", "fp")
    else:
        probes = probes.select("part", "key", F.lit(0).alias("block"), "probe", "fp")
    dealt = probes.repartition("part", "key", "block").sortWithinPartitions("part", "key", "block", "probe")
    return dealt.mapInArrow(_links(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): roots are equal just within a component. Each round takes the
    least root among a node's neighbours, then follows roots to their own roots, until nothing changes."""
    both = written(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        step = roots.join(near, "node").select("node", F.least("root", "least").alias("root"), F.col("root").alias("was"))
        onward = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = written(step.join(onward, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"), "roots")
        if new.where(F.col("root") != F.col("was")).isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def _grouped(docs: DataFrame, key: str, text: str, shingle: int, distance: int) -> DataFrame:
    """``near_duplicates`` with ``root``, a fingerprint that names the component where keys occur more than once."""
    rows = written(fingerprints(docs, key, text, shingle), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    found = written(links(classes, classes.count(), distance), "links")
    if found.isEmpty():
        joined = classes.select("fp", F.col("first").alias("component"), F.col("fp").alias("root"))
    else:
        roots = classes.join(components(found).withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first")
        least = roots.groupBy("root").agg(F.min("first").alias("least"))
        moved = written(roots.join(least, "root").select("fp", "least", "root"), "components")
        joined = classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component"), F.coalesce("root", "fp").alias("root"))
    return rows.join(joined, "fp").select(key, "fp", "component", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """Per row: ``key``, ``fp`` and ``component``, the smallest key that links of ``distance`` bits or fewer reach from
    it, its own included. Rows without words have the fingerprint 0, which links like any other; repeated rows and ties
    share a component; keys may be null, and a component of null keys alone has a null id."""
    return _grouped(docs, key, text, shingle, distance).select(key, "fp", "component")


def _with_fingerprint(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` and ``__fp`` of each row."""
    rows = docs.withColumn("__bytes", text_of(text).cast("binary"))

    def run(batches):
        for batch in slices(batches):
            last = batch.num_columns - 1
            fps = pa.array([fingerprint(x, shingle) for x in batch.column(last).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(last)), fps], [*batch.schema.names[:last], "__fp"])
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest key; rows with a null key stay. If several rows of
    the component have that key, one of them stays. Other columns travel in a struct, so their names cannot clash."""
    columns, docs = docs.columns, packed(docs, key, text)
    return unpacked(_deduplicated(docs, key, text, shingle, distance), columns, **{key: F.col(key), text: F.col(text)})


def _deduplicated(docs: DataFrame, key: str, text: str, shingle: int, distance: int) -> DataFrame:
    found = written(_grouped(docs, key, text, shingle, distance), "near")
    drop = written(found.where(F.col(key) != F.col("component")).select(key).distinct(), "drop")
    n_drop = drop.count()
    left = lambda df: df.join(small_side(drop, n_drop, 32), key, "left_anti").select(*docs.columns)
    twice = written(found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "twice")
    if not (n := twice.count()):
        return left(docs)
    # a key that occurs again does not tell its rows' components: their fingerprints do
    many = _with_fingerprint(docs.join(small_side(twice, n, 32), key, "left_semi").select(*docs.columns), text, shingle)
    of = found.join(small_side(twice, n, 32), key, "left_semi").where(F.col(key) == F.col("component")) \
        .select(F.col("fp").alias("__fp"), F.col("component").alias("__least"), F.col("root").alias("__root")).distinct()
    first = F.row_number().over(Window.partitionBy("__root").orderBy(*[F.col(c) for c in docs.columns if c != key]))
    one = many.join(of, "__fp").where(F.col(key) == F.col("__least")).withColumn("__first", first).where("__first = 1").select(*docs.columns)
    return left(docs.join(small_side(twice, n, 32), key, "left_anti").select(*docs.columns)).unionAll(one)
