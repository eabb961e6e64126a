"""Near copies by SimHash over several blocks of bits: texts that share 0.8 or more of their runs of five words.

Similarity is the Jaccard index of two texts' sets of distinct runs of `words` words (ASCII lower case, split at ASCII
white space). At 0.8, two 64-bit fingerprints differ in some ten bits, too many for a ball around the whole. So a text
gets a long fingerprint, cut into blocks of `width` bits; in a block, texts meet by ball hashing as in `simhash`, with
radius 2: each emits all words within one bit, dealt out by their first bits and completed in the receiving task, and
texts that share a word meet. The cosine of two sets of Jaccard index s is 2s/(1+s) at least, so the chance that a block
differs in two bits at most is known, and `shape` takes as many blocks as find a pair at the threshold with the given
recall (pairs above it are found more surely). The width follows the number of texts, so that unlike texts rarely meet.

Texts that meet, unless 128 further bits rule them out, are put into classes where they meet, each named by its first
text; a group is all that has met one such text. All are compared exactly, by their sets, so nothing below the threshold
is linked: each text with the least that it has met first. The texts of groups that are not yet in one component then meet
by members of their sets: in any one order of all members, two sets at the threshold share one among the first of either,
and its places tell how large the other set may be. Rare members come first in that order (a sample tells them), so a text
that differs too much from the rest of its group meets nothing, and what shares frequent ones is alike. Of such a bucket,
each text is compared with the one that has the fewest rare members; what is still of several components there is compared
in blocks inside a task, which returns a forest, all but the bucket's largest component with everything. Buckets that
share texts are joined where that sends fewer sets. Pairs are not emitted; no group or bucket is capped and no pair dropped.

Defined results: a null text is an empty one; texts alike in their words are one node; of each class the row with the
smallest id stays (without any id, that with the least digest), once if it is repeated; an empty table gives an empty
result. All runs of words of a text of any length count. The input's columns come back as they are, but for columns named
like this module's own, which begin with two underscores.
"""

from __future__ import annotations

import hashlib
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
from docgate.llm.simhash import SEED, _forest

WORDS = 5
#: The similarity from which texts are near copies, as a fraction.
LEAST = (4, 5)
#: Chance that a pair right at the threshold meets.
RECALL = 0.98
#: Bits of a block beyond the binary logarithm of the number of texts. More of them take more blocks, and so more rows to
#: shuffle; with fewer, more unlike texts share a word, which costs their task a comparison of check bits.
SPARE = 2
#: Texts that begin with the same bits of a block, on average (each bit more is one more row a block); texts of a bucket above which it is dealt out by words.
PER_PREFIX, MOST = 1024, 100_000
#: Texts of a word up to which all words of a place are compared together.
TOGETHER = 32
#: Texts to compare whose digests (16 bytes and an id each) are broadcast.
FEW = 1_000_000
#: Texts of a bucket that are compared in one block, and bytes of their sets at most, about.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Members of whole sets drawn to tell frequent members from rare ones, about; sets of a bucket differ in size by this factor at most, so that it holds few that can't be alike.
SAMPLE, STEP = 1_000_000, 1.05
#: Bits beyond the blocks by which unlike pairs are told, and standard deviations by which a true pair's may differ more than expected.
CHECK, SURE = 128, 5.0


def normal(text: bytes) -> list[bytes]:
    return text.lower().split()


def digest(found: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(found), usedforsecurity=False).digest()


def shingles(found: list[bytes], words: int = WORDS) -> np.ndarray:
    """The distinct runs of `words` words as sorted 64-bit hashes; of a shorter text, all of it."""
    from xxhash import xxh64_intdigest

    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    return np.unique(np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64))


def differing(least: tuple[int, int]) -> float:
    """The chance that a bit differs between texts at the threshold."""
    s = least[0] / least[1]
    return math.acos(min(1.0, 2 * s / (1 + s))) / math.pi


def shape(count: int, least: tuple[int, int] = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """The width of a block in bits, and the number of blocks."""
    p, width = differing(least), min(48, max(20, SPARE + math.ceil(math.log2(max(2, count)))))
    close = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(3))
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - close))) if close < 1 else 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit words of SimHash of a set: a bit is 1 if set in more than half of the members' hashes, each mixed anew for every word."""
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(words * 64, np.int64)
    for lo in range(0, len(hashes), 255):
        bits = np.unpackbits(_mix(hashes[lo : lo + 255, None] ^ salt[None, :]).view(np.uint8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes)).view(np.uint64)


def blocks_of(long: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """long: (texts, words). The blocks of each as numbers."""
    bits = np.unpackbits(long.view(np.uint8), axis=1)[:, : width * blocks].reshape(len(long), blocks, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _signatures(df: DataFrame, id_col: str, text_col: str, words: int, long_words: int) -> DataFrame:
    """(doc_id, node, long) for each row: a digest of its words, and its long fingerprint."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                found = [normal(t or b"") for t in batch.column("text").to_pylist()]
                long = [long_fingerprint(shingles(f, words), long_words).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest(f) for f in found], pa.binary()), pa.array(long, pa.binary())], ["doc_id", "node", "long"])

    made = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("node", T.BinaryType()), T.StructField("long", T.BinaryType())])
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, made)


def _with_node(df: DataFrame, text_col: str) -> DataFrame:
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, 8 << 20):
                nodes = [digest(normal((t or "").encode())) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], [*batch.schema.names, "__node"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__node", T.BinaryType())]))


def _dealt(nodes: DataFrame, width: int, blocks: int, prefix: int) -> DataFrame:
    """nodes: (id, long). (place, id, word, c0, c1): each text's places (a block and the first `prefix` bits of its words there), its bits of the block, and `CHECK` further bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.uint64(width - prefix)
        flips = np.concatenate([[0], np.uint64(1) << np.arange(prefix, dtype=np.uint64)]).astype(np.uint64)
        base = np.arange(blocks, dtype=np.uint64) << np.uint64(prefix)
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                long = np.frombuffer(b"".join(batch.column("long").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                word = blocks_of(long[:, :-2].copy(), width, blocks)
                place = (base[None, :, None] | ((word >> rest)[:, :, None] ^ flips[None, None, :])).reshape(len(long), -1)
                per = place.shape[1]
                columns = [place.ravel(), np.repeat(batch.column("id").to_numpy(), per), np.repeat(word, len(flips), axis=1).ravel(), np.repeat(long[:, -2], per), np.repeat(long[:, -1], per)]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["place", "id", "word", "c0", "c1"])

    return nodes.mapInArrow(run, "place long, id long, word long, c0 long, c1 long")


def near_bits(check: np.ndarray, left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
    """Whether the check bits of each of `left` and each of `right` (positions) allow them to be near copies."""
    return np.bitwise_count(check[left][:, None, :] ^ check[right][None, :, :]).sum(axis=2, dtype=np.int64) <= apart


def meet(place: int, word: np.ndarray, check: np.ndarray, width: int, prefix: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts of a place, in the order of their ids: those that share words with others that the check bits allow, each with the first of its class (positions)."""
    rest = width - prefix
    start = np.uint64(place & ((1 << prefix) - 1))
    whole = np.flatnonzero((word >> np.uint64(rest)) == start)  # these may differ by one bit in the rest, all others in none
    low = word & np.uint64((1 << rest) - 1)
    flips = np.uint64(1) << np.arange(rest, dtype=np.uint64)
    made = np.concatenate([low, (low[whole, None] ^ flips[None, :]).ravel()])
    owner = np.concatenate([np.arange(len(word)), np.repeat(whole, rest)])
    order = np.lexsort((owner, made))
    made, owner = made[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1], [True]]))
    size = np.diff(cuts)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # each text of a small word with the next one there, then with the one after that, and so on
    small = np.flatnonzero((size > 1) & (size <= TOGETHER))
    end = np.repeat(cuts[small] + size[small], size[small])
    at = np.arange(len(end)) + np.repeat(cuts[small] - (np.cumsum(size[small]) - size[small]), size[small])
    for k in range(1, TOGETHER):
        has = at + k < end
        at, end = at[has], end[has]
        if not len(at):
            break
        i, j = owner[at], owner[at + k]
        near = np.bitwise_count(check[i] ^ check[j]).sum(axis=1, dtype=np.int64) <= apart
        left.append(i[near])
        right.append(j[near])
    for at in np.flatnonzero(size > TOGETHER).tolist():
        members = owner[cuts[at] : cuts[at + 1]]
        if len(members) <= 512:
            i, j = np.nonzero(np.triu(near_bits(check, members, members, apart), 1))
            left.append(members[i])
            right.append(members[j])
        else:  # linked as they are: the exact comparison decides
            left.append(members[1:])
            right.append(np.full(len(members) - 1, members[0]))
    pairs = np.unique(np.concatenate(left) * len(word) + np.concatenate(right))  # alike in all bits, they share many words
    return _forest(len(word), pairs // len(word), pairs % len(word))


def _meetings(rows: DataFrame, width: int, prefix: int, apart: int) -> DataFrame:
    """(a, b): b shares words, directly or over others of its place, with a, the first of its class there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(place: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            group = pa.Table.from_batches(parts)
            if group.num_rows < 2:
                return None
            ids, word = group.column("id").to_numpy(), group.column("word").to_numpy().view(np.uint64)
            check = np.stack([group.column(c).to_numpy() for c in ("c0", "c1")], axis=1).view(np.uint64)
            order = np.argsort(ids)
            ids = ids[order]
            node, root = meet(place, word[order], check[order], width, prefix, apart)
            return pa.RecordBatch.from_arrays([pa.array(ids[root]), pa.array(ids[node])], ["a", "b"])

        at, kept = None, []
        for batch in batches:
            place = batch.column("place").to_numpy()
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if kept and place[lo] != at:
                    if (made := out(at, kept)) is not None:
                        yield made
                    kept = []
                at = int(place[lo])
                kept.append(batch.slice(lo, hi - lo))
        if kept and (made := out(at, kept)) is not None:
            yield made

    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(run, "a long, b long")


def _by_words(rows: DataFrame, width: int, prefix: int) -> DataFrame:
    """As _meetings for crowded places, each word a key of its own."""
    rest = width - prefix
    start = F.col("place").bitwiseAND(F.lit((1 << prefix) - 1))
    low = F.col("word").bitwiseAND(F.lit((1 << rest) - 1))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(rest)])
    made = F.when(F.shiftrightunsigned("word", rest) == start, flips).otherwise(F.array(F.lit(0).cast("long")))
    each = rows.select("place", "id", low.alias("low"), F.explode(made).alias("flip"))
    each = each.select("id", F.unhex(F.sha1(F.concat_ws(":", "place", F.col("low").bitwiseXOR(F.col("flip"))))).alias("key"))
    least = written(each.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded-words")
    return each.join(least, "key").filter("id <> a").select("a", F.col("id").alias("b"))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """rows: (id, text). (id, size, hashes), the hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                own = [shingles(normal((t or "").encode()), words) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "size", "hashes"])

    return rows.mapInArrow(run, "id long, size long, hashes binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b), those whose sets' similarity reaches the threshold."""
    above, below = least
    sizes = sets.select("id", "size")
    near = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    # sets whose sizes differ more can't be that similar
    near = written(near.filter(F.least("na", "nb") * below >= F.greatest("na", "nb") * above).select("a", "b"), "near-pairs")
    full = sets.select("id", "hashes")
    if near.count() <= FEW:  # only the sets that are compared are moved
        others = F.broadcast(near.select("b").distinct())
        both = full.toDF("a", "of_a").join(F.broadcast(near), "a").join(full.toDF("b", "of_b").join(others, "b", "left_semi"), "b")
    else:
        both = near.join(full.toDF("a", "of_a"), "a").join(full.toDF("b", "of_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                take.append(shared * below >= (len(x) + len(y) - shared) * above)
            yield batch.select(["a", "b"]).filter(pa.array(take, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def shared_members(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of each of `left` with each of `right` (positions)."""
    lens = np.array(list(map(len, sets)))
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), lens)
    order = np.argsort(member, kind="stable")
    member, of = member[order], of[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(member[-1]) + 1 if len(member) else 0, 4096):
        a, b = np.searchsorted(member, [lo, lo + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[of[a:b], member[a:b] - lo] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _usual(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of a bounded sample of the sets (size, hashes): the members found more than once, sorted, and how often. Only speed depends on it."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, math.ceil((1 << 20) * min(1, SAMPLE / max(1, total)))))
    drawn = drawn.filter(F.col("size") <= SAMPLE // 16).select("hashes").toArrow().column("hashes")
    member, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in drawn)]), return_counts=True)
    return member[often > 1], often[often > 1]


def first_members(own: np.ndarray, usual: np.ndarray, often: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The first members of a set by frequency and value, of which any set that reaches the threshold with it shares one; and
    for each the size up to which another set may reach it if it shares no earlier one."""
    above, below = least
    n = len(own)
    count = np.zeros(n, np.int64)
    if len(usual):
        at = np.minimum(np.searchsorted(usual, own), len(usual) - 1)
        count = np.where(usual[at] == own, often[at], 0)
    order = np.lexsort((own, count))[: n - -(-n * above // below) + 1]
    # sets of n and m members are alike if they share (n + m) * above / (above + below); from place p on, n - p are left
    return own[order], (n - np.arange(len(order))) * (above + below) // above - n


def _by_members(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """rows: (id, root, size, hashes). (member, id, root, size, most, rare) for the first members of each set: the size of another up to which it counts, and the share of members before it."""
    usual, often = _usual(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "hashes", 8 << 20):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]
                found = [first_members(x, usual, often, least) if len(x) else (x, x.view(np.int64)) for x in own]
                each = np.array([len(x) for x, _ in found], np.int64)
                size = np.repeat(np.array(list(map(len, own)), np.int64), each)
                place = np.arange(len(size)) - np.repeat(np.cumsum(each) - each, each)
                columns = [np.concatenate([x for x, _ in found]).view(np.int64), *(np.repeat(batch.column(c).to_numpy(), each) for c in ("id", "root")), size, np.concatenate([y for _, y in found]), place / np.maximum(1, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["member", "id", "root", "size", "most", "rare"])

    return rows.select("id", "root", "hashes").mapInArrow(run, "member long, id long, root long, size long, most long, rare double")


def _of_several(rows: DataFrame, *key: str) -> DataFrame:
    """The rows of keys with more than one root."""
    rows = rows.repartition(*key)  # once: the aggregate and the join need no other exchange
    several = rows.groupBy(*key).agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select(*key)
    return rows.join(several, list(key), "left_semi")


def _links_of(forest: DataFrame) -> DataFrame:
    return forest.select(F.col("root").alias("a"), F.col("node").alias("b"))


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    own = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(own, F.col("id") == F.col("__node"), "left").withColumn("root", F.coalesce("__root", "id")).drop("__node", "__root")


def _centres(rows: DataFrame) -> DataFrame:
    """rows as of _by_members. (a, b): each text b with one that has the fewest rare members of those it meets."""
    centre = rows.groupBy("member").agg(F.min(F.struct("rare", "id", "size", "most")).alias("c"))
    met = rows.join(centre, "member").filter((F.col("id") != F.col("c.id")) & (F.col("size") <= F.col("c.most")) & (F.col("c.size") <= F.col("most")))
    return met.groupBy("id").agg(F.min(F.struct("c.rare", "c.id")).alias("c")).select(F.col("c.id").alias("a"), F.col("id").alias("b"))


def _buckets(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """rows as of _by_members. (member, step, id, root, size): texts that may be alike, those of a bucket with the smaller texts of one step of sizes."""
    above, below = least
    step = F.floor(F.log("size") / math.log(STEP))
    smaller = rows.filter("most >= size").groupBy("member", step.alias("step")).agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("most").alias("most"))
    steps = smaller.groupBy("member").agg(F.collect_list(F.struct("step", "lo", "hi", "most")).alias("steps"))
    fits = F.filter("steps", lambda s: (s["lo"] <= F.least("size", "most")) & (F.col("size") <= s["most"]) & (s["hi"] * below >= F.col("size") * above))
    return rows.join(steps, "member").select("member", F.explode(fits.getField("step")).alias("step"), "id", "root", "size")


def _unlike_buckets(rows: DataFrame) -> DataFrame:
    """rows: (member, step, id, root, size). Of buckets with the same texts, told by 128 bits, one: texts that share several members make the same bucket as often."""
    key = ["member", "step"]
    ids = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"x{k}") for k in (1, 2)]
    made = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *ids).groupBy("n", "x1", "x2").agg(F.min(F.struct(*key)).alias("b"))
    return rows.join(written(made.select("b.*"), "unlike-buckets"), key)


def _blocks(n: Column, size: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / block), F.ceil(size * 8 / BLOCK_BYTES)).cast("long")


def _gathered(rows: DataFrame, block: int) -> DataFrame:
    """rows: (member, step, id, root, size). Buckets that share texts, directly or over others, become one, of step -1, where fewer texts are dealt out so: a text that is in many of them is sent once a block then."""
    first = rows.groupBy("member", "step").agg(F.min("id").alias("a"))
    of = components(rows.join(first, ["member", "step"]).select("a", F.col("id").alias("b")))
    named = rows.join(of.select(F.col("node").alias("__node"), F.col("root").alias("__all")), F.col("id") == F.col("__node"), "left")
    named = written(named.select(*rows.columns, F.coalesce("__all", "id").alias("all")), "clusters")
    texts = named.groupBy("all", "id").agg(F.min("root").alias("root"), F.min("size").alias("size"), F.count(F.lit(1)).alias("often"))
    sums = texts.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("often").alias("often"))
    whole = written(sums.filter(F.col("n") * _blocks(F.col("n"), F.col("size"), block) <= F.col("often")).select("all"), "whole-clusters")
    joined = texts.join(whole, "all", "left_semi").select(F.col("all").alias("member"), F.lit(-1).cast("long").alias("step"), "id", "root", "size")
    return joined.unionByName(named.join(whole, "all", "left_anti").select(*rows.columns))


def _dealt_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows: (member, step, id, root, size), buckets of several roots. Each text with the pairs of blocks (lo, hi) in which it is compared; no two blocks of the bucket's largest component meet. A bucket that fits a block is one."""
    key = ["member", "step"]
    by_root = rows.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    made = by_root.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("size").alias("bytes"), F.max(F.struct("n", "size", "root")).alias("main"))
    fits = _blocks(F.col("n"), F.col("bytes"), block) == 1
    off = _blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.size"), block)
    on = F.when(fits, F.lit(0).cast("long")).otherwise(_blocks(F.col("main.n"), F.col("main.size"), block))
    made = made.select(*key, F.col("main.root").alias("main"), off.alias("off"), on.alias("on"))
    dealt = rows.join(written(made, "bucket-sizes"), key)
    main, at = (F.col("root") == F.col("main")) & (F.col("on") > 0), F.xxhash64("id")
    dealt = dealt.withColumn("block", F.when(main, F.col("off") + F.pmod(at, F.greatest("on", F.lit(1).cast("long")))).otherwise(F.pmod(at, F.col("off"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(main, F.col("off")).otherwise(F.col("off") + F.col("on")) - 1)))
    return dealt.select(*key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "root")


def _in_blocks(dealt: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """dealt: as of _dealt_blocks. Compares the texts of different components; returns a forest of links."""
    above, below = least
    place = ["member", "step", "lo", "hi"]
    rows = dealt.join(sets.select("id", "hashes"), "id").select(*place, "block", "id", "root", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kept: list[dict]) -> pa.RecordBatch | None:
            block = np.array([r["block"] for r in kept])
            left, right = np.flatnonzero(block == kept[0]["lo"]), np.flatnonzero(block == kept[0]["hi"])
            if not len(left) or not len(right):
                return None
            own = [np.frombuffer(r["hashes"], np.uint64) for r in kept]
            size = np.array(list(map(len, own)))
            roots = {r: k for k, r in enumerate({r["root"] for r in kept})}
            root = np.array([roots[r["root"]] for r in kept])
            both = shared_members(own, left, right)
            union = size[left][:, None] + size[right][None, :] - both
            hit = (both * below >= union * above) & (root[left][:, None] != root[right][None, :])
            i, j = np.nonzero(hit)
            if not len(i):
                return None
            a, b = _forest(len(kept), left[i], right[j])
            return pa.RecordBatch.from_arrays([pa.array([kept[x]["id"] for x in a.tolist()], pa.int64()), pa.array([kept[x]["id"] for x in b.tolist()], pa.int64())], ["a", "b"])

        at, kept = None, []
        for batch in batches:
            for r in batch.to_pylist():
                here = (r["member"], r["step"], r["lo"], r["hi"])
                if here != at:
                    if len(kept) > 1 and (made := out(kept)) is not None:
                        yield made
                    at, kept = here, []
                kept.append(r)
        if len(kept) > 1 and (made := out(kept)) is not None:
            yield made

    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, count: int, df: DataFrame, text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST, recall: float = RECALL, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """nodes: (id, node, long). Links (a, b) between ids whose components are those of all near copies that meet."""
    width, blocks = shape(count, least, recall)
    prefix = min(width - 4, max(4, math.ceil(math.log2(max(1, count / PER_PREFIX)))))
    p = differing(least)
    apart = math.ceil(CHECK * p + SURE * math.sqrt(CHECK * p * (1 - p)))
    rows = _dealt(nodes.select("id", "long"), width, blocks, prefix)
    # the rows are made anew for this count rather than written: making them is cheaper than a table of all of them
    crowded = written(rows.groupBy("place").count().filter(F.col("count") > most).select("place"), "crowded")
    if crowded.isEmpty():
        found = _meetings(rows, width, prefix, apart)
    else:
        found = _meetings(rows.join(crowded, "place", "left_anti"), width, prefix, apart).unionByName(_by_words(rows.join(crowded, "place", "left_semi"), width, prefix))
    found = written(found, "meetings")
    # a group is what has met one text as the first of a class; each of its members meets its least such text first
    met = written(found.distinct(), "met")
    star = written(met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    members = met.select(F.col("a").alias("key"), F.col("b").alias("id")).unionByName(met.select(F.col("a").alias("key"), F.col("a").alias("id")).distinct())
    wanted = members.select("id").distinct()
    wanted = written(nodes.join(wanted, "id", "left_semi").select("id", F.col("node").alias("__wanted")), "candidates")
    texts = _with_node(df.select(F.col(text_col).alias("text")), "text")
    named = F.col("__node") == F.col("__wanted")
    if wanted.count() <= FEW:  # a bounded list goes to all tasks, so that only the texts it names are moved
        texts = texts.join(F.broadcast(wanted), named).dropDuplicates(["id"])
    else:  # copies are dropped before the shuffle, so that none of them is a hot key
        texts = texts.dropDuplicates(["__node"]).join(wanted, named)
    sets = written(_sets(texts.select("id", "text"), words), "sets")
    linked = written(_alike(star, sets, least), "alike")
    forest = components(linked)
    placed = members.join(forest.withColumnRenamed("node", "__node"), F.col("id") == F.col("__node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    placed = written(placed, "placed")
    mixed = written(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key"), "mixed")
    left = written(placed.join(mixed, "key", "left_semi").select("id", "root").distinct(), "left")
    few = left.count() <= FEW
    left = sets.join(F.broadcast(left) if few else left, "id")
    rows = written(_by_members(left if few else written(left, "left-sets"), least), "members")
    rows = written(_of_several(rows, "member"), "shared")
    # later links join what earlier ones made of texts: their forest, not they, is what is taken along
    forest = components(_links_of(forest).unionByName(written(_alike(_centres(rows), sets, least), "alike")))
    rows = written(_of_several(_with_roots(rows, forest), "member"), "shared")
    rows = written(_of_several(_buckets(rows, least), "member", "step"), "buckets")
    rows = _gathered(written(_unlike_buckets(rows), "buckets"), block)
    return _links_of(forest).unionByName(written(_in_blocks(_dealt_blocks(rows, block), sets, least), "alike"))


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST, recall: float = RECALL, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row of each class of near copies, with all its columns."""
    count = df.count()
    width, blocks = shape(count, least, recall)
    signatures = written(_signatures(df, id_col, text_col, words, -(-(width * blocks) // 64) + CHECK // 64), "signatures")
    nodes = signatures.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("long").alias("long"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    roots = components(links(nodes.select("id", "node", "long"), count, df, text_col, words, least, recall, most, block))
    of = nodes.join(roots.withColumnRenamed("node", "__of"), nodes["id"] == F.col("__of"), "left").select("node", "least", F.coalesce("root", "id").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("first")
    kept = of.groupBy("root").agg(first).select(F.col("first.least").alias("__id"), F.col("first.node").alias("__kept"))
    again = written(signatures.groupBy("doc_id", "node").count().filter("count > 1").select("node"), "repeated-rows")
    # what is kept has no size bound, so it may not be broadcast
    own = _with_node(df, text_col)
    rows = own.join(kept.hint("merge"), (own["__node"] == kept["__kept"]) & own[id_col].eqNullSafe(kept["__id"]), "left_semi")
    if not again.isEmpty():
        rows = rows.dropDuplicates([id_col, "__node"])
    return rows.drop("__node")
