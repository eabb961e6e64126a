"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints differ in at most four bits exactly if some 64-bit word lies within two bits of both. Every
distinct fingerprint therefore emits all 2081 words within two bits of it, and fingerprints that share a word are
linked; as such words are within two bits of each, their owners are within four bits of one another, so linking a
word's owners in a chain finds all links' classes without making pairs.

The words are dealt out in two steps, since shuffling 2081 rows a document would cost many times the input. The
first `k` bits of a word choose its bucket: a fingerprint goes to the 1 + k + k(k-1)/2 buckets that its words can
begin with, and the task that holds a bucket makes the rest of the words there, sorts them and compares the owners
of equal ones. A bucket whose fingerprints would make more than `most` words (near copies crowd in few) is dealt out
again by its next bits, down to single words if need be; those are linked to their smallest owner by an aggregate. No
bucket is capped and no owner dropped. Each bucket returns a forest: a link per fingerprint at most. A task holds some
50 bytes a word.

Defined results: a null text is an empty one; fingerprint zero is linked like any other; a null doc_id counts only
where no other is in its class; repeated rows get equal results; an empty table gives an empty result. All
shingles of a text of any length count. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import slices, small_batches, written
from docgate.llm.components import components

SEED = 42
RADIUS = 4
BITS = 64
#: Words made in a bucket; more are dealt out again.
MOST = 4_000_000
#: Distinct fingerprints that begin with the same k bits, on average.
PER_PREFIX = 64


def fingerprint(text: bytes, words: int = 4) -> bytes:
    """The SimHash of a text in UTF-8, eight bytes with the highest bit first."""
    from xxhash import xxh64_digest

    found = text.lower().split()
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    if len(found) <= words:
        return xxh64_digest(joined, SEED)
    digests = b"".join([xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes()


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 4) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for each row."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                texts = batch.column("text").to_pylist()
                fps = np.frombuffer(b"".join([fingerprint(t or b"", words) for t in texts]), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())]))


def flips(bits: int, radius: int) -> list[np.ndarray]:
    """For r = 0..radius, the masks over `bits` low bits with at most r bits set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if radius >= 1:
        out.append(np.concatenate([out[0], one]))
    if radius >= 2:
        i, j = np.triu_indices(bits, 1)
        out.append(np.concatenate([out[1], one[i] | one[j]]))
    return out[: radius + 1]


def words_made(bucket: Column, fp: Column, used: int, radius: int) -> Column:
    """How many words of a fingerprint begin with the bucket's bits."""
    rest = BITS - used
    made = [1, 1 + rest, 1 + rest + rest * (rest - 1) // 2]
    left = radius - (F.bit_count(bucket.bitwiseXOR(F.shiftrightunsigned(fp, rest))) if used else F.lit(0))
    return F.element_at(F.array(*[F.lit(n).cast("long") for n in made[: radius + 1]]), (left + 1).cast("int"))


def _deal(rows: DataFrame, used: int, more: int, radius: int) -> DataFrame:
    """rows: (bucket, fp), a bucket being the first `used` bits of words. Deals them out by `more` further bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = flips(more, radius)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                bucket = batch.column("bucket").to_numpy().view(np.uint64)
                fp = batch.column("fp").to_numpy().view(np.uint64)
                left = radius - (np.bitwise_count(bucket ^ (fp >> np.uint64(BITS - used))).astype(int) if used else 0)
                middle = (fp >> np.uint64(BITS - used - more)) & np.uint64((1 << more) - 1)
                base = (bucket << np.uint64(more) if used else np.uint64(0)) | middle
                for r in range(radius + 1):
                    of = np.flatnonzero(np.broadcast_to(left, fp.shape) == r)
                    if len(of):
                        out = base[of][:, None] ^ masks[r][None, :]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(out.ravel().view(np.int64)), pa.array(np.repeat(fp[of], len(masks[r])).view(np.int64))], ["bucket", "fp"]
                        )

    return rows.mapInArrow(run, "bucket long, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between 0..n-1: each linked node but the smallest of its class, with that smallest."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    touched = np.unique(np.concatenate([a, b]))
    roots = np.array([top(x) for x in touched.tolist()], dtype=np.int64)
    off = touched != roots
    return touched[off], roots[off]


def collide(bucket: int, fps: np.ndarray, used: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links among the fingerprints of a bucket, as a forest: (fingerprint, smallest of its class here)."""
    fps = np.unique(fps)
    n, rest = len(fps), BITS - used
    none = np.zeros(0, np.uint64)
    if n < 2:
        return none, none
    left = radius - np.bitwise_count(np.uint64(bucket) ^ (fps >> np.uint64(rest))).astype(int)
    masks = flips(rest, radius)
    suffix = fps & np.uint64((1 << rest) - 1)
    words, owners = [], []
    for r in range(radius + 1):
        of = np.flatnonzero(left == r)
        words.append((suffix[of][:, None] ^ masks[r][None, :]).ravel())
        owners.append(np.repeat(of.astype(np.uint64), len(masks[r])))
    word, owner = np.concatenate(words), np.concatenate(owners)
    low = np.uint64(max(1, (n - 1).bit_length()))
    # word and owner in one number, to sort without an index: exact if both fit, else by a hash that is checked below
    mixed = word if rest + int(low) <= BITS else word * np.uint64(0x9E3779B97F4A7C15) >> low
    packed = np.sort((mixed << low) | owner)
    same = packed[1:] >> low == packed[:-1] >> low
    own = packed & ((np.uint64(1) << low) - np.uint64(1))
    pairs = np.unique(own[:-1][same] * np.uint64(n) + own[1:][same])
    a, b = (pairs // np.uint64(n)).astype(np.int64), (pairs % np.uint64(n)).astype(np.int64)
    if (np.bitwise_count(fps[a] ^ fps[b]) > 2 * radius).any():  # the hash put different words together
        order = np.lexsort((owner, word))
        word, own = word[order], owner[order].astype(np.int64)
        same = word[1:] == word[:-1]
        a, b = own[:-1][same], own[1:][same]
        assert (np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius).all()
    node, root = _forest(n, a, b)
    return fps[node], fps[root]


def _collide(rows: DataFrame, used: int, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_bucket, kept = None, []

        def out(bucket: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            node, root = collide(bucket, np.concatenate(parts), used, radius)
            return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])

        for batch in batches:
            bucket, fp = batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if kept and bucket[lo] != kept_bucket:
                    yield out(kept_bucket, kept)
                    kept = []
                kept_bucket = int(bucket[lo])
                kept.append(fp[lo:hi].copy())
        if kept:
            yield out(kept_bucket, kept)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def ball_links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST, per_prefix: int = PER_PREFIX) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` of nodes that join exactly those within `radius` bits."""
    half = radius // 2
    count = nodes.count()
    used = min(40, max(8, math.ceil(math.log2(max(1, count / per_prefix)))))
    rows = _deal(nodes.select(F.lit(0).cast("long").alias("bucket"), "fp"), 0, used, half)
    found = []
    while True:
        # the rows are made anew for this count rather than written: making them is cheaper than a table of all of them
        size = F.sum(words_made(F.col("bucket"), F.col("fp"), used, half)).alias("size")
        crowded = written(rows.groupBy("bucket").agg(size).filter(F.col("size") > most).select("bucket"), "crowded")
        if crowded.isEmpty():
            found.append(_collide(rows, used, half))
            break
        found.append(_collide(rows.join(crowded, "bucket", "left_anti"), used, half))
        more = min(8, BITS - used)
        rows = written(_deal(rows.join(crowded, "bucket", "left_semi"), used, more, half), "words")
        used += more
        if used == BITS:
            least = rows.groupBy("bucket").agg(F.min("fp").alias("b"))
            found.append(rows.join(least, "bucket").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct())
            break
    out = found[0]
    for more_links in found[1:]:
        out = out.unionByName(more_links)
    return out


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id (the smallest doc_id that links reach)."""
    docs = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(ball_links(nodes, radius, most))
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of = written(of, "roots")
    least = written(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(of.join(least, "root").select(F.col("fp").alias("node"), "component_id"), "classes")
    return docs.join(named, docs["fp"] == named["node"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = RADIUS) -> DataFrame:
    """The row with the smallest id of each class, with all its columns.

    Where ids repeat, a row is told by id and text; of rows alike in both, one stays. Classes of rows without any id
    keep one row for each text.
    """
    found = written(classes(df, id_col, text_col, words, radius), "simhash-classes")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    again = written(found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")), "repeated-ids")
    kept = first.select(F.col("doc_id").alias("__id")).distinct()
    # what is kept has no size bound, so it may not be broadcast
    rows = df.join(kept.hint("merge"), df[id_col].eqNullSafe(kept["__id"]), "left_semi")
    if again.isEmpty():
        return rows
    once = rows.join(again, rows[id_col].eqNullSafe(again["__again"]), "left_anti")
    repeated = rows.join(again, rows[id_col].eqNullSafe(again["__again"]), "left_semi").dropDuplicates([id_col, text_col])
    own = written(fingerprints(repeated, id_col, text_col, words).distinct(), "repeated-fingerprints")
    own = own.withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0")).join(first.select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__fp")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fingerprint") == F.col("__fp")), "left_semi")
    marked = _with_fingerprint(repeated, text_col, words)
    own = own.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__own"))
    left = marked.join(own, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__own")), "left_semi")
    return once.unionByName(left.dropDuplicates([id_col, "__fp"]).drop("__fp"))


def _with_fingerprint(df: DataFrame, text_col: str, words: int) -> DataFrame:
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [int.from_bytes(fingerprint((t or "").encode(), words), "big", signed=True) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, "__fp"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__fp", T.LongType())]))
