"""Packing documents into sequences by first-fit decreasing, in randomised groups.

A map task turns a document into ids with the end id behind, and cuts it into pieces of `length` ids and a rest.
A piece falls into a group by a hash of its document's id, its start, its ids and its place among equal ones in
the order in which a task makes them, some thousand documents to a group whatever the table, so that a group is a random
mix of sizes, and rows that share an id (or have none) are dealt out like others. A task that is run again deals out the same if it
reads its rows in the same order, as from files; pieces of rows whose order isn't `stable` are written first.
Within a group pieces come in decreasing size, and each goes into the first
sequence with room for it, found by a tournament tree over the sequences' free room in O(log n). As they come in
that order, a task places them one by one and holds nothing but the tree.

Defined results: a null text counts as empty, so that its document is the end id alone; an empty table gives an
empty result; repeated rows are packed again; pieces of equal length go in by id and start. Texts are encoded whole,
whatever their length, and cut anywhere between two ids. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import slices, small_batches, written
from docgate.llm.tokens import Splitter

LENGTH = 2048
END = 1
#: Documents of a group, about.
GROUP = 4096
#: Distinct pre-tokens whose ids a task remembers.
REMEMBER = 400_000


class Room:
    """The free room of sequences, with the first that has so much found from the root of a tournament tree."""

    def __init__(self, length: int):
        self.length, self.leaves, self.used = length, 1, 0
        self.tree = [0, length]  # unopened sequences count as empty ones: the first fit may open one

    def place(self, size: int) -> tuple[int, int]:
        """The sequence that takes a piece of this size, and where it begins there."""
        if self.tree[1] < size or self.used == self.leaves and self.tree[1] >= self.length:
            self._grow()
        at = 1
        while at < self.leaves:
            at *= 2
            if self.tree[at] < size:
                at += 1
        free = self.tree[at]
        self.tree[at] = free - size
        self.used = max(self.used, at - self.leaves + 1)
        found = at - self.leaves
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        return found, self.length - free

    def _grow(self) -> None:
        leaves = self.tree[self.leaves :] + [self.length] * self.leaves
        self.leaves *= 2
        self.tree = [0] * self.leaves + leaves
        for at in range(self.leaves - 1, 0, -1):
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])


def encode(splitter: Splitter, texts: list[str], known: dict[str | int, list[int]], end: int) -> Iterator[np.ndarray]:
    """The ids of each text with the end id behind, put together from those of its pre-tokens."""
    pieces, found, sizes = splitter.split(texts)
    if len(known) > REMEMBER:
        known.clear()
    each = []
    for p in pieces:
        if (ids := known.get(p)) is None:
            known[p] = ids = splitter.ids(p)
        each.append(ids)
    counts = np.array(list(map(len, each)), np.int64)
    flat = np.fromiter((i for ids in each for i in ids), np.uint32, int(counts.sum()))
    begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(texts)):
        of = found[bounds[i] : bounds[i + 1]]
        n = counts[of]
        total = int(n.sum())
        out = np.full(total + 1, end, np.uint32)
        out[:total] = flat[np.repeat(begin[of] - np.cumsum(n) + n, n) + np.arange(total)]
        yield out


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, group: int = GROUP, stable: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. stable: a partition of df has its rows in the same order whenever it is read."""
    spark = df.sparkSession
    small_batches(spark)
    groups = max(1, round(df.count() / group))
    id_type = df.schema[id_col].dataType
    head = [T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())]
    cut_type = T.StructType([*head, T.StructField("turn", T.LongType())])
    out_type = T.StructType([*head, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        splitter, known, shrink, turn = Splitter(tokenizer), {}, zstandard.ZstdCompressor(level=1), 0
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                of, starts, sizes, data, totals = [], [], [], [], []
                for i, ids in enumerate(encode(splitter, [t or "" for t in batch.column("text").to_pylist()], known, end)):
                    for at in range(0, len(ids), length):
                        part = ids[at : at + length].astype("<u4")
                        of.append(i)
                        starts.append(at)
                        sizes.append(len(part))
                        data.append(shrink.compress(part.tobytes()))
                        totals.append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary()), pa.array(totals, pa.int64()), pa.array(np.arange(turn, turn + len(of)))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "turn"],
                )
                turn += len(of)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow, at, room = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            where = []
            for number, size in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if number != at:
                    at, room = number, Room(length)
                found, offset = room.place(size)
                where.append((number << 32 | found, offset))
            ids = [grow.decompress(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length")), pa.array(ids, pa.binary()), batch.column("doc_tokens"), *(pa.array([w[k] for w in where], pa.int64()) for k in (0, 1))],
                [f.name for f in out_type],
            )

    pieces = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, cut_type)
    dealt = (pieces if stable else written(pieces, "pieces")).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids", "turn", F.lit("pack")), F.lit(groups))).drop("turn")
    order = dealt.repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start")
    return order.mapInArrow(fit, out_type)
