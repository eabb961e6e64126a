"""Substring dedup by seed and extend.

Words are hashed, and every window of `length` words has one anchor: the `gram`-word sequence with the smallest mixed
hash among those inside it (winnowing), the first of equal ones. Neighbouring windows mostly share theirs, so a
document has an anchor about every fifteenth word. Equal windows have equal anchors at equal places; documents are
therefore joined on anchors, and an anchor that occurs once in the corpus ends there with all its windows.

A repeated anchor is extended both ways. Each occurrence carries a hash of its whole run, all the words of the windows
that have it as their anchor. If the runs of all its occurrences are equal, all are repeats from end to end. Otherwise
(at the ends of shared passages, and where copies differ) the texts are fetched again, and the windows of each run are
compared by two 64-bit hashes. Repeats that overlap or touch are merged into maximal ones.

Counts go through aggregates with map-side combining; occurrences are joined to them with the occurrences' side free
to be split, so a passage in a third of all documents crowds no task. Texts that are equal word for word are extended
once, with their number of copies as weight.

Defined results: a null text has no words; a text shorter than a window has no repeats; repeated rows are repeats of
one another; an empty table gives an empty result. A text of any length is cut into words whole; windows that
tie for an anchor take the first. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import small_batches, written

LENGTH = 35
GRAM = 8
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any run of words: sums of word hashes times powers of an odd base."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, base: int):
        n = len(words) + 1
        power, inverse = self.powers.get(base, (np.zeros(0, np.uint64),) * 2)
        if len(power) < n:
            size = max(1 << 15, 1 << (n - 1).bit_length())
            power, inverse = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
            self.powers[base] = power, inverse
        self.inverse = inverse
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(map(xxh64_digest, words)), ">u8").astype(np.uint64)


def anchors(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, run, first window, number of windows) of each run of windows with one anchor."""
    n = len(hashes)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    rolling = Rolling(hashes, BASES[0])
    grams = rolling.of(np.arange(n - gram + 1), np.arange(gram, n + 1))
    span = length - gram + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n - length + 1)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(place)]]))
    run = rolling.of(first, first + count + (length - 1))
    run = _mix(run + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place[first] - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return grams[place[first]].view(np.int64), run.view(np.int64), first, count


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n words lie in one of the intervals."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    return np.cumsum(step[:-1]) > 0


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, digest, data): the words of each text, joined by single spaces and compressed, and a 128-bit hash of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from xxhash import xxh3_128_digest

        shrink = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, digest = [], []
            for text in batch.column("text"):
                words = b" ".join((text.as_py() or b"").split())
                data.append(shrink.compress(words))
                digest.append(xxh3_128_digest(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(data, pa.binary())], ["doc_id", "digest", "data"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    made = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("digest", T.BinaryType()), T.StructField("data", T.BinaryType())])
    return written(rows.mapInArrow(run, made).withColumn("row", F.monotonically_increasing_id()), "texts")


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [anchors(word_hashes(grow.decompress(d.as_py()).split()), length, gram) for d in batch.column("data")]
            row = np.repeat(batch.column("row").to_numpy(), [len(f[0]) for f in found])
            parts = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(parts[0]), pa.array(parts[1]), pa.array(parts[2].astype(np.int32)), pa.array(parts[3].astype(np.int32))], ["row", "anchor", "run", "first", "count"])

    return written(texts.select("row", "data").mapInArrow(run, "row long, anchor long, run long, first int, count int"), "anchors")


def _windows(runs: DataFrame, length: int) -> DataFrame:
    """runs: (data, row, copies, runs: array of first and count). A row per window: row, copies, start, two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, row, copies, own in zip(batch.column("data"), batch.column("row").to_pylist(), batch.column("copies").to_pylist(), batch.column("runs"), strict=True):
                hashes = word_hashes(grow.decompress(data.as_py()).split())
                start = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in own.as_py()]))
                pair = [Rolling(h, b).of(start, start + length) for h, b in zip((hashes, _mix(hashes + np.uint64(BASES[1]))), BASES, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), row)), pa.array(np.full(len(start), copies)), pa.array(start.astype(np.int32)), *(pa.array(p.view(np.int64)) for p in pair)], ["row", "copies", "start", "one", "two"])

    return runs.select("data", "row", "copies", "runs").mapInArrow(run, "row long, copies long, start int, one long, two long")


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts: (row, digest, data). Returns (row, spans, whole): word intervals covered by repeated windows, or that all is, as the text has a copy."""
    copies = written(texts.groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")).drop("digest"), "copies")
    found = _anchor_rows(texts, length, gram)
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min("run").alias("least"), F.max("run").alias("most")).filter("times > 1")
    # a table of its own, so that the join reads two plain exchanges, of which Spark can split a crowded partition
    again = written(again.select(F.col("anchor").alias("__anchor"), (F.col("least") == F.col("most")).alias("alike")), "repeated-anchors")
    # of equal texts, the first stands for all
    joined = found.select("row", "anchor", "first", "count").join(again, F.col("anchor") == F.col("__anchor")).select("row", "first", "count", "alike")
    seeds = written(joined.join(copies.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row")).drop("__row"), "seeds")
    open_runs = seeds.filter("not alike").groupBy("row", "copies").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    fetched = open_runs.withColumnRenamed("row", "__row").join(texts.select("row", "data"), F.col("row") == F.col("__row"))
    windows = written(_windows(fetched, length), "windows")
    twice = windows.groupBy("one", "two").agg(F.sum("copies").alias("times")).filter("times > 1").select(F.col("one").alias("__one"), F.col("two").alias("__two"))
    twice = written(twice, "repeated-windows")
    same = windows.filter("copies = 1").join(twice, (F.col("one") == F.col("__one")) & (F.col("two") == F.col("__two")))
    spans = same.select("row", F.col("start"), (F.col("start") + length).alias("stop")).unionByName(
        seeds.filter("alike and copies = 1").select("row", F.col("first").alias("start"), (F.col("first") + F.col("count") + (length - 1)).alias("stop"))
    )
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    twins = copies.filter("copies > 1").select("row")
    twin_rows = texts.select("row", "digest").join(texts.join(twins, "row", "left_semi").select("digest"), "digest", "left_semi").select("row", F.lit(True).alias("whole"))
    return written(spans.withColumn("whole", F.lit(False)).unionByName(twin_rows.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select("row", "spans", "whole")), "spans")


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, repeats (maximal repeats as first word and word behind the last), kept (the words that stay, joined by a space)."""
    small_batches(df.sparkSession)
    texts = _texts(df, id_col, text_col)
    found = repeats(texts, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            total, gone, merged, kept = [], [], [], []
            for data, spans, whole in zip(batch.column("data"), batch.column("spans"), batch.column("whole").to_pylist(), strict=True):
                text = grow.decompress(data.as_py())
                words = text.split()
                n = len(words)
                if whole and n >= length:
                    away = np.ones(n, bool)
                elif spans.is_valid:
                    flat = spans.values
                    away = covered(n, flat.field("start").to_numpy(), flat.field("stop").to_numpy())
                else:
                    away = None
                total.append(n)
                if away is None:
                    gone.append(0)
                    merged.append([])
                    kept.append(text)
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], away.astype(np.int8), [0]])))
                gone.append(int(away.sum()))
                merged.append([{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(b" ".join([w for w, a in zip(words, away.tolist(), strict=True) if not a]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "repeats", "kept"]
            )

    made = T.StructType([texts.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), *T._parse_datatype_string("repeats array<struct<start:int,stop:int>>, kept string").fields])
    rows = texts.select("row", "doc_id", "data").join(found.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"), "left").select("doc_id", "data", "spans", "whole")
    return rows.mapInArrow(run, made)
