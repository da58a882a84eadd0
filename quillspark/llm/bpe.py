"""Byte-level BPE encoding and decoding, by length-bucketed padded matrices.

A text is cut by the tokenizer's pattern; each piece is encoded by itself. Pieces that are a token already take its
id. The others of a batch are put into padded numpy matrices, one per length bucket, a row a piece. In each round
every row finds the rank of all its neighbouring pairs' merges, merges its leftmost pair of least rank and closes the
gap; only the two ranks next to a merge are looked up again, in an open-addressing hash table of pairs. Rows without
a pair left leave the matrix, and the matrix narrows with its longest row. A piece of more than ``WIDE`` bytes is a row
of its own; there a round may merge every non-overlapping occurrence of the least pair at once if no merge that uses the
new token ranks below it (then the one-by-one order gives the same). Of more than ``LONG`` bytes, its pairs lie in a heap by
rank and place instead of a matrix row: the same merges in the same order, at a cost in proportion to its length.

Pieces met before in a task come from a cache of at most ``CACHE`` pieces; the rank file is read on the driver, where its
path is a parameter, and reaches the tasks as one broadcast (a vocabulary is of fixed size).

Ids are kept as binary: unsigned 32-bit, little-endian, one after the other. A null text is encoded as the empty one, a
null id string is decoded as the empty text. A column of the output's name is replaced. Bytes that aren't UTF-8
become U+FFFD before encoding, as Python decodes them. Repeated rows are encoded alike; equal ranks merge leftmost first; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import by_value, slices

by_value(__name__)

WIDE, LONG, CELLS, CACHE, ROWS = 64, 4096, 1 << 16, 1 << 17, 256
NONE = np.int32(np.iinfo(np.int32).max)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by id, a hash table from pairs of ids to the id of their merge, and which merges may be done at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(x, dtype=np.int32) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int32),) * 3
        lowest = np.full(len(self.tokens), NONE, dtype=np.int32)
        np.minimum.at(lowest, left, merged)
        np.minimum.at(lowest, right, merged)
        self.at_once = lowest > np.arange(len(self.tokens))
        self.bits = max(4, int(4 * len(merged) + 16).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY, dtype=np.uint64)
        self.merges = np.full(1 << self.bits, NONE, dtype=np.int32)
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):  # each round, the first of those that want a free slot gets it; the others go on
            free = todo[self.keys[slot[todo]] == EMPTY]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.merges[slot[put]] = key[put], merged[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_of(self, left, right):
        """Ids of the merges of pairs, ``NONE`` where there is none; a negative id is padding."""
        pad = (left < 0) | (right < 0)
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.merges[slot], NONE)
        more = np.flatnonzero((found != key) & (found != EMPTY) & ~pad)
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[more]]
            hit = found == key[more]
            out[more[hit]] = self.merges[slot[more[hit]]]
            more = more[~hit & (found != EMPTY)]
        out[pad] = NONE
        return out

    def encode_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of one bucket's length, one padded matrix."""
        n = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        width = int(n.max())
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        ids[np.arange(width) < n[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = self.merge_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        out = [b""] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), dtype=np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                length = n[done]
                packed = ids[done][np.arange(ids.shape[1]) < length[:, None]].astype("<u4").tobytes()
                ends = 4 * np.cumsum(length)
                for k, a, b in zip(row[done].tolist(), (ends - 4 * length).tolist(), ends.tolist()):
                    out[k] = packed[a:b]
            live = ~done
            ids, rank, n, row, at, best = ids[live], rank[live], n[live] - 1, row[live], at[live], best[live]
            if not len(row):
                break
            r = np.arange(len(row))
            ids[r, at] = best
            width = int(n.max())
            cols = np.arange(width)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            ids[cols >= n[:, None]] = -1
            rank = np.take_along_axis(rank, np.minimum(cols[:-1] + (cols[:-1] > at[:, None]), rank.shape[1] - 1), axis=1)
            if width > 1:
                rank[cols[:-1] >= n[:, None] - 1] = NONE
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < n - 1)
                    rank[r[ok], side[ok]] = self.merge_of(ids[r[ok], side[ok]], ids[r[ok], side[ok] + 1])
        return out

    def encode_wide(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece."""
        ids = self.bytes[np.frombuffer(piece, dtype=np.uint8)]
        rank = self.merge_of(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best) if self.at_once[best] else np.array([rank.argmin()])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
            at = at[run % 2 == 0]  # of pairs that overlap, the first, third and so on
            ids[at] = best
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids = ids[keep]
            near = at - np.arange(len(at))
            rank = np.delete(rank, np.minimum(at + 1, len(rank) - 1))[: len(ids) - 1]
            near = np.concatenate((near, near - 1))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.merge_of(ids[near], ids[near + 1])
        return ids

    def encode_long(self, piece: bytes) -> np.ndarray:
        """Ids of one very long piece: its pairs lie in a heap by rank and place, so that each merge costs the logarithm of
        the piece's length, however many different ranks there are."""
        ids, n, none = self.bytes[np.frombuffer(piece, dtype=np.uint8)], len(piece), int(NONE)
        rank = self.merge_of(ids[:-1], ids[1:])
        first = np.flatnonzero(rank != NONE)
        heap = (rank[first].astype(np.int64) << 32 | first).tolist()
        heapq.heapify(heap)
        ids, rank, after, before = ids.tolist(), [*rank.tolist(), none], list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks, push, pop = self.tokens, self.ranks.get, heapq.heappush, heapq.heappop
        while heap:
            at = pop(heap)
            best, at = at >> 32, at & 0xFFFFFFFF
            if rank[at] != best:  # the pair is no more
                continue
            gone = after[at]
            ids[at], ids[gone], rank[gone] = best, -1, none
            after[at] = right = after[gone]
            rank[at] = r = ranks(tokens[best] + tokens[ids[right]], none) if right < n else none
            if right < n:
                before[right] = at
            if r != none:
                push(heap, r << 32 | at)
            left = before[at]
            if left >= 0:
                rank[left] = r = ranks(tokens[ids[left]] + tokens[best], none)
                if r != none:
                    push(heap, r << 32 | left)
        out = np.array(ids, dtype=np.int32)
        return out[out >= 0]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; bucketed by length."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[k] = self.encode_long(piece).astype("<u4").tobytes()
            elif len(piece) > WIDE:
                out[k] = self.encode_wide(piece).astype("<u4").tobytes()
            elif piece:
                buckets.setdefault((len(piece) + 3) // 4, []).append(k)
        for size, members in buckets.items():
            for i in range(0, len(members), CELLS // (4 * size)):
                part = members[i : i + CELLS // (4 * size)]
                for k, ids in zip(part, self.encode_rows([pieces[k] for k in part])):
                    out[k] = ids
        return out


def _with(df: DataFrame, column: str, out: str, carry: list[str] | None, make) -> DataFrame:
    """The ``carry`` columns of ``df`` (all, if None) and a binary column ``out``, made from each Arrow batch's ``column``."""
    carry = [c for c in (df.columns if carry is None else carry) if c != out]
    named = df.select(*carry, F.col(column).cast("binary").alias("__bytes")) if column not in carry else df.select(*carry)
    at = len(carry) if column not in carry else carry.index(column)

    def run(batches):
        encoded = make()
        for part in slices(batches, ROWS):
            values = part.column(at)
            values = values if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else values.cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(encoded(values.to_pylist()), pa.binary())], [*carry, out])
    return named.mapInArrow(run, T.StructType([*df.select(*carry).schema.fields, T.StructField(out, T.BinaryType())]))


def broadcast_vocabulary(spark, path: str):
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))


def encode(df: DataFrame, text: str, vocabulary, pattern: str, out: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Adds the packed ids of ``text``. ``vocabulary`` is a broadcast ``Vocabulary``."""

    def make():
        import regex
        cut, words, cache = regex.compile(pattern).findall, vocabulary.value, {}

        def encoded(column):
            texts = [cut((x or b"").decode("utf-8", "replace")) for x in column]
            if len(cache) > CACHE:
                cache.clear()
            new = list({p for pieces in texts for p in pieces if p not in cache})
            cache.update(zip(new, words.encode([p.encode() for p in new])))
            return [b"".join(map(cache.__getitem__, pieces)) for pieces in texts]
        return encoded
    return _with(df, text, out, carry, make)


def decode(df: DataFrame, ids: str, vocabulary, out: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """Adds the bytes that the packed ``ids`` stand for; an id without a token is an error."""

    def make():
        tokens = vocabulary.value.tokens
        return lambda column: [b"".join([tokens[i] for i in np.frombuffer(x or b"", dtype="<u4").tolist()]) for x in column]
    return _with(df, ids, out, carry, make)
