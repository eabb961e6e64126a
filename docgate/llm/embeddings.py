"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised; each of several tables hashes them by `k` random projections, shifted and cut into cells of
a fixed width. For unit vectors the cosine fixes the Euclidean distance, so the chance that two share a bucket is
known: `shape` picks k so that unlike vectors rarely meet at this number of vectors, and as many tables as it takes
to find a pair at the threshold itself with the given recall (pairs above it are found more surely).

Two passes keep the shuffle small. The first deals out bucket, node and a sketch of `SKETCH` sign bits, but no vector;
a bucket's sketches are compared, and a vector goes on only if some other there is near enough that the pair could
reach the threshold (a true pair's sketches differ more with a chance of about 1e-7). The second sends the vectors
themselves to those buckets, where they are compared by cosine in double precision, in matrix blocks inside a task:
pairs are counted and linked there, never emitted. A pair that meets in several tables counts in the first of them,
which the task tells by hashing its vectors again.

Equal vectors are compared once: each distinct vector has a weight. A bucket with more than a block's vectors is cut
into blocks, and every pair of blocks is a task of its own, so that near copies in any number are all compared and
none crowds a task.

Defined results: a vector that is null, zero, empty or holds a null or non-finite component links with nothing,
vectors of different length neither; a null vec_id counts only where no other is in its component; repeated rows
link with one another; an empty table gives an empty result. Other columns, labels too, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import small_batches, written
from docgate.llm.components import components
from docgate.llm.simhash import _forest

COSINE = 0.95
SEED = 20240
WIDTH = 2.0
#: Chance that a pair right at the threshold is found.
RECALL = 0.99
#: Unlike vectors (cosine 0.2 and below) that a vector may meet in a bucket, about.
MEET = 512
#: Sketches, and vectors, of a block.
MOST = 8192
#: Bits of a sketch, and the standard deviations by which a true pair's may differ more than expected.
SKETCH, SURE = 128, 5.3


def together(distance: float, width: float = WIDTH) -> float:
    """The chance that one projection puts two vectors at this distance into the same cell."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(count: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections of a table, and tables."""
    near, far = together(math.sqrt(2 - 2 * cosine)), together(math.sqrt(2 - 2 * 0.2))
    k = max(4, math.ceil(math.log(max(1, count / MEET)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def codes(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A 64-bit bucket for each vector (row) and table."""
    rng = np.random.default_rng([SEED, unit.shape[1], k, tables])
    direction = rng.standard_normal((unit.shape[1], tables * k))
    shift = rng.random(tables * k) * WIDTH
    mixer = rng.integers(1, 1 << 63, tables * k, dtype=np.uint64) | np.uint64(1)
    cell = np.floor((unit @ direction + shift) / WIDTH).astype(np.int64).astype(np.uint64)
    out = (cell * mixer).reshape(len(unit), tables, k).sum(axis=2, dtype=np.uint64)
    out ^= out >> np.uint64(31)
    return (out * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def unit_vectors(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(unit: np.ndarray) -> np.ndarray:
    """The signs of random projections of each vector (row), as 64-bit numbers."""
    direction = np.random.default_rng([SEED + 1, unit.shape[1]]).standard_normal((unit.shape[1], SKETCH))
    return np.packbits(unit @ direction >= 0, axis=1).view(np.int64)


def most_apart(cosine: float) -> int:
    """The bits by which the sketches of a pair at the threshold differ, at most."""
    p = math.acos(min(1.0, cosine)) / math.pi
    return math.ceil(SKETCH * p + SURE * math.sqrt(SKETCH * p * (1 - p)))


def has_partner(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
    """For each sketch, whether another of the other side is near it. left and right: positions to compare; the same array if all."""
    sketch = sketch.view(np.uint64)  # of signed numbers, bits of the absolute value would count
    near = np.zeros(len(sketch), bool)
    other = sketch[right]
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        differ = np.zeros((len(rows), len(right)), np.uint8)
        for word in range(sketch.shape[1]):
            differ += np.bitwise_count(sketch[rows, word][:, None] ^ other[None, :, word])
        hit = differ <= apart
        if left is right:
            hit[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
        near[rows] |= hit.any(axis=1)
        near[right] |= hit.any(axis=0)
    return near


def compare(unit: np.ndarray, code: np.ndarray, weight: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors that share a bucket of a table: links of each (by weight), and the pairs' forest. left and right: positions to compare; the same array if all."""
    links = np.zeros(len(unit), np.int64)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    all_pairs = left is right
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= cosine)
        a, b = rows[i], right[j]
        if all_pairs:
            a, b = a[a < b], b[a < b]
        if table:
            new = ~(code[a, :table] == code[b, :table]).any(axis=1)
            a, b = a[new], b[new]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        node, root = _forest(len(unit), a, b)
        found_a.append(node)
        found_b.append(root)
    node, root = _forest(len(unit), np.concatenate(found_a), np.concatenate(found_b))
    return links, node, root


PLACE = ["bucket", "tab", "lo", "hi"]


def _in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """rows: (bucket, tab, node, ...). Adds block, lo and hi: a bucket with more than `most` rows is cut into blocks, and a
    row goes to every pair of blocks that its own is in. Rows alone in their bucket have nothing to meet and go."""
    sizes = written(rows.groupBy("bucket", "tab").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / most)).drop("count"), "buckets")
    dealt = rows.join(sizes, ["bucket", "tab"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that stand together by PLACE, a table for each place with two rows or more."""
    at, kept = None, []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in PLACE])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if start == stop:
                continue
            here = tuple(key[:, start].tolist())
            if here != at:
                if sum(k.num_rows for k in kept) > 1:
                    yield at, pa.Table.from_batches(kept).combine_chunks()
                at, kept = here, []
            kept.append(batch.slice(start, stop - start))
    if sum(k.num_rows for k in kept) > 1:
        yield at, pa.Table.from_batches(kept).combine_chunks()


def _sides(place: tuple, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, lo, hi = place
    if lo == hi:
        everything = np.arange(len(block))
        return everything, everything
    return np.flatnonzero(block == lo), np.flatnonzero(block == hi)


def links(vectors: DataFrame, cosine: float = COSINE, most: int = MOST) -> DataFrame:
    """vectors: (node, key, weight, kind), key being the components of a distinct valid vector as `kind` has them. Returns (a, b, n): links of a by weight if b is null, else a link."""
    k, tables = shape(vectors.count(), cosine)
    apart = most_apart(cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            sizes = np.array(list(map(len, keys)), np.int64)
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                unit = unit_vectors([keys[i] for i in of.tolist()], batch.column("kind")[0].as_py())
                code, sketch = codes(unit, k, tables) ^ size, sketches(unit)  # vectors of different length don't meet
                node = batch.column("node").take(pa.array(of))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(code[:, t]), pa.array(np.full(len(of), t, np.int32)), node, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["bucket", "tab", "node", "s0", "s1"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, group in _groups(batches):
            left, right = _sides(place, group.column("block").to_numpy())
            sketch = np.stack([group.column(c).to_numpy() for c in ("s0", "s1")], axis=1)
            near = has_partner(sketch, left, right, apart)
            if near.any():
                yield group.select(["bucket", "tab", "node"]).filter(pa.array(near)).combine_chunks().to_batches()[0]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, group in _groups(batches):
            unit = unit_vectors(group.column("key").to_pylist(), group.column("kind")[0].as_py())
            table = place[1]
            weight, block, node = (group.column(c).to_numpy() for c in ("weight", "block", "node"))
            left, right = _sides(place, block)
            count, a, b = compare(unit, codes(unit, k, tables) if table else np.zeros((len(unit), 0)), weight, table, left, right, cosine)
            of = np.flatnonzero(count)
            n = len(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[of], node[a]])), pa.array(np.concatenate([np.zeros(n, np.int64), node[b]]), mask=np.arange(n + len(a)) < n), pa.array(np.concatenate([count[of], np.zeros(len(a), np.int64)]))], ["a", "b", "n"]
            )

    rows = vectors.select("node", "key", "kind").mapInArrow(hashed, "bucket long, tab int, node long, s0 long, s1 long")
    dealt = _in_blocks(rows, most).select(*PLACE, "block", "node", "s0", "s1")
    wanted = dealt.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(candidates, "bucket long, tab int, node long")
    wanted = written(wanted.distinct(), "vectors-to-compare")
    dealt = _in_blocks(wanted, most).join(vectors, "node").select(*PLACE, "block", "node", "weight", "key", "kind")
    return dealt.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(met, "a long, b long, n long")


def dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, most: int = MOST) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    small_batches(df.sparkSession, 4000)
    single = isinstance(df.schema[vector_col].dataType, T.ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"  # as they are stored: no more bytes than the input has

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, digests = [], []
            column = batch.column("values")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # -0.0 is 0.0
            ends = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            good = np.isfinite(flat)
            for start, end in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                own = flat[start:end]
                valid = end > start and good[start:end].all() and own.any()
                raw.append(own.tobytes() if valid else None)
                digests.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if valid else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "key"])

    made = T.StructType([T.StructField("vec_id", df.schema[id_col].dataType), T.StructField("digest", T.BinaryType()), T.StructField("key", T.BinaryType())])
    values = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = written(df.select(F.col(id_col).alias("vec_id"), values.alias("values")).mapInArrow(keyed, made), "vectors")
    distinct = rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("key").alias("key"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    found = written(links(distinct.select("node", "key", "weight", F.lit(kind).alias("kind")), cosine, most), "vector-links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b"))
    named = distinct.select("digest", "node", "least", "weight").join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named.join(counts, F.col("node") == F.col("a"), "left").select("digest", "root", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "vector-roots")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    classes = written(named.join(least, "root").select(F.col("digest").alias("__digest"), "n_links", "component_id"), "vector-classes")
    lone = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.join(classes, F.col("digest") == F.col("__digest")).select("vec_id", "n_links", "component_id")
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
