"""Token counts by distinct pre-token.

A map task cuts a block of texts into pre-tokens and, for each of `parts` parts of their hash space, sends one row:
the block's distinct pre-tokens there, and for each its documents and frequencies. The task that holds a part counts
the pieces of each distinct pre-token once, joins the counts to the frequencies and returns a sum for each document
of each block; a block's sums are added up with its documents' ids. Token ids are never made for a document.

A common pre-token is one entry per block, whatever its frequency, so no part is much larger than another. A block sends
a row to each part, so there are `MOST_PARTS` at most. Where the session deals shuffles out to more tasks than that, a
part is dealt out again by the map task that a block comes from, so that as many tasks as asked for share the work, each
in proportion; a pre-token is then counted once for each of these shares of the map tasks.

Defined results: a null text counts as empty and has no tokens; a text of any length is read whole, one of more than
`BLOCK` bytes as a block of its own; special strings inside a text count as the library
takes them by default; repeated rows give repeated results; an empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import slices, small_batches
from docgate.llm.tokens import Splitter

LIMIT = 2048
#: Bytes of text that a map task handles at once.
BLOCK = 8 << 20
#: Parts of the hash space, at most: a block sends a row to each. Counts of distinct pre-tokens that a task remembers.
MOST_PARTS, REMEMBERED = 1024, 2_000_000
#: The part number of a block's own row: ids, sizes and special tokens.
OWN = -1


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    import zstandard

    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _unpacked(data: bytes, count: int) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * count, []
    for size in struct.unpack_from(f"<{count}q", raw):
        out.append(raw[at : at + size])
        at += size
    return out


def block_rows(splitter: Splitter, texts: list[str], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, its pre-tokens and frequencies) of a block, and the special tokens of each document under OWN."""
    from xxhash import xxh64_intdigest

    pieces, found, sizes = splitter.split(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    key, freq = np.unique(found * len(texts) + doc, return_counts=True)
    piece, doc = key // max(1, len(texts)), key % max(1, len(texts))
    special = np.array([isinstance(p, int) for p in pieces], bool)
    own = np.zeros(len(texts), np.int64)
    if special.any():
        of = special[piece]
        np.add.at(own, doc[of], freq[of])
    yield OWN, own.tobytes()
    raw = [b"" if isinstance(p, int) else p.encode() for p in pieces]
    part = np.array([xxh64_intdigest(r) % parts for r in raw], np.int64)
    part[special] = -1
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    first = np.searchsorted(piece, np.arange(len(pieces) + 1))  # a piece's postings stand together
    for p in range(parts):
        here = order[bounds[p] : bounds[p + 1]]
        if not len(here):
            continue
        counts = first[here + 1] - first[here]
        at = np.repeat(first[here] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        names = [raw[i] for i in here.tolist()]
        yield p, _packed(
            np.array(list(map(len, names)), np.uint32), b"".join(names), counts.astype(np.uint32), doc[at].astype(np.uint32), freq[at].astype(np.uint32)
        )


def part_sums(data: bytes, known: dict[str, int], docs: int) -> np.ndarray:
    """Tokens of each document of a block that come from one part's pre-tokens."""
    lens, names, counts, doc, freq = _unpacked(data, 5)
    ends = np.cumsum(np.frombuffer(lens, np.uint32).astype(np.int64)).tolist()
    tokens = np.array([known[names[a:b].decode()] for a, b in zip([0, *ends], ends, strict=False)], np.int64)
    each = np.repeat(tokens, np.frombuffer(counts, np.uint32)) * np.frombuffer(freq, np.uint32)
    return np.bincount(np.frombuffer(doc, np.uint32), each, docs).astype(np.int64)


def shares(tasks: int) -> tuple[int, int]:
    """The number of parts of the hash space, and of shares of the map tasks that each is dealt out to: together at least twice the tasks of a shuffle."""
    parts = min(MOST_PARTS, max(8, 2 * tasks))
    return parts, max(1, -(-2 * tasks // parts))


def count(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. tokenizer: the path of its file, readable on every executor."""
    spark = df.sparkSession
    small_batches(spark)
    parts, spread = shares(int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = df.schema[id_col].dataType
    made = T.StructType([T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("docs", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        splitter, number = Splitter(tokenizer), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", block):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows = list(block_rows(splitter, texts, parts))
                sink = pa.BufferOutputStream()
                own = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(np.frombuffer(rows[0][1], np.int64))], ["doc_id", "n_bytes", "special"])
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                rows[0] = (OWN, sink.getvalue().to_pybytes())
                for part, data in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part], pa.int32()), pa.array([len(texts)], pa.int32()), pa.array([data], pa.binary())], names=["block", "part", "docs", "data"])
                number += 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(tokenizer)

        class Known(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= REMEMBERED:  # counted again when they come again
                    self.clear()
                self[piece] = n = len(splitter.ids(piece))
                return n

        known, at = Known(), None
        for batch in batches:
            for part, docs, data, i in zip(batch.column("part").to_pylist(), batch.column("docs").to_pylist(), batch.column("data"), range(batch.num_rows), strict=True):
                if part == OWN:
                    yield batch.slice(i, 1)
                    continue
                if part != at:
                    known, at = Known(), part
                sums = part_sums(data.as_py(), known, docs)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:3], pa.array([_packed(sums.astype(np.uint32))], pa.binary())], schema=batch.schema)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, own = None, None, None

        def out() -> pa.RecordBatch:
            tokens = np.frombuffer(own.column("special").to_numpy(), np.int64) + (0 if sums is None else sums)
            return pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            for number, part, data in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if number != at:
                    if at is not None:
                        yield out()
                    at, sums, own = number, None, None
                if part == OWN:
                    own = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
                else:
                    more = np.frombuffer(_unpacked(data.as_py(), 1)[0], np.uint32).astype(np.int64)
                    sums = more if sums is None else sums + more
        if at is not None:
            yield out()

    result = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, made)
    share = F.pmod(F.shiftright("block", 32), F.lit(spread)) * parts
    dealt = rows.withColumn("to", F.when(F.col("part") == OWN, F.pmod("block", F.lit(parts))).otherwise(F.col("part")) + share)
    sums = dealt.repartition("to").sortWithinPartitions("to", "part").drop("to").mapInArrow(add, made)
    return sums.repartition("block").sortWithinPartitions("block").mapInArrow(total, result)
