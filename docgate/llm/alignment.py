"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

A is a byte-level BPE (a `tokenizers` file) over a space and the text, B a sentencepiece BPE with byte fallback, which
puts that space before the text itself. Every byte has a label: nothing ends there, a token of A does, one of B does,
or both do. A regular expression scans the label string and takes each span up to a both-label: a group. The labels
in it count its tokens on either side, so a running count gives them; all pairs of a token of A and one of B in a group
are links.

Neither tokenizer merges across a single space or line feed between other characters, so a text is cut there into
units; each ends with a both-label, and its labels are the same wherever it stands. A task encodes and scans a distinct
unit once and puts texts together from units. If B's vocabulary had a piece across such a place, texts stay whole.

Id pairs are counted by documents over the whole corpus: a block of texts sends each of its distinct pairs once, with
the number of its documents, so a common pair is one row a block; the counts come back to the blocks, whose postings
(document, pair, links) turn them into sums. Nothing about a document but its block's row is moved.

Defined results: a null or empty text has no tokens, nor has one whose tokens' bytes, joined, are not the space and
the text (U+2581 in a text, for one); then all numbers are 0 and groups_sha256 is ''. Strings of special tokens inside
a text are plain text. Texts of any length are read whole; a text without spaces is one unit. Repeated rows (and ids)
are documents of their own; ties for the highest count all count as best; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import slices, small_batches, written
from docgate.llm.tokens import byte_letters

#: Labels of a byte.
A_END, B_END, BOTH = 1, 2, 3
#: A group: all labels up to and with a both-label.
GROUP = re.compile(b"[^\x03]*\x03")
#: Before a single space or line feed that stands between other characters.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Bytes of text in a block, units that a task remembers, and those that A gets as one text.
BLOCK, REMEMBER, TOGETHER = 2 << 20, 250_000, 64
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def labels(size: int, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """The label string of so many bytes; ends: the bytes after each token."""
    out = np.zeros(size, np.uint8)
    out[ends_a - 1] |= A_END
    out[ends_b - 1] |= B_END
    return out.tobytes()


def groups(label: bytes) -> list[tuple[int, int]]:
    """The number of A's and of B's tokens in each group."""
    spans = GROUP.findall(label)
    counts = {span: (span.count(A_END) + 1, span.count(B_END) + 1) for span in set(spans)}
    return [counts[span] for span in spans]


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.gap = self.b.piece_to_id("▁")
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in names)
        self.a_size, self.b_size = (np.array(list(map(len, of)), np.int64) for of in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        """No unit is known: their places, groups as text, counts (none: bytes differ), pairs and links."""
        self.known: dict[str, int] = {}
        self.said: list[str | None] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.width, self.pairs, self.links = (np.zeros(0, np.int64) for _ in range(3))

    def units(self, text: str) -> list[str]:
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def _ids_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all units, and the number of each unit's. Units that others may stand next to, as each would be cut off there, are encoded together."""
        apart = [len(u) < 2 or u[1].isspace() or u[-1].isspace() for u in units]
        texts, held = [], []
        for at in range(0, len(units), TOGETHER):
            part = units[at : at + TOGETHER]
            if any(apart[at : at + TOGETHER]):
                texts += part
                held += [1] * len(part)
            else:
                texts.append("".join(part))
                held.append(len(part))
        made = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter((i for of in made for i in of), np.int64, sum(map(len, made)))
        ends = np.cumsum([len(u.encode()) for u in units])
        return ids, np.diff(np.searchsorted(np.cumsum(self.a_size[ids]), ends, "right"), prepend=0)

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        """B's ids of each unit: it puts a space before all it gets, a unit's own or one that goes again."""
        made = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [y if u[0] == " " else y[1:] if y[:1] == [self.gap] else [] for u, y in zip(units, made, strict=True)]

    def learn(self, units: list[str]) -> None:
        """Distinct new units, with one label string for all of them: each ends with a both-label, so that no group is of two."""
        of_a, n_a = self._ids_a(units)
        b = self._ids_b(units)
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        of_b = np.fromiter((i for of in b for i in of), np.int64, int(n_b.sum()))
        raw = list(map(str.encode, units))
        unit_a, unit_b = (np.repeat(np.arange(len(units)), n) for n in (n_a, n_b))
        bytes_a, bytes_b = ([names[i] for i in of.tolist()] for names, of in ((self.a_bytes, of_a), (self.b_bytes, of_b)))
        good = np.ones(len(units), bool)
        if b"".join(bytes_a) != (whole := b"".join(raw)) or b"".join(bytes_b) != whole or self._uneven(raw, unit_a, of_a, unit_b, of_b):
            upto_a, upto_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
            good = np.array([b"".join(bytes_a[i - m : i]) == r == b"".join(bytes_b[j - n : j]) for r, i, m, j, n in zip(raw, upto_a, n_a.tolist(), upto_b, n_b.tolist(), strict=True)], bool)
            of_a, of_b = of_a[good[unit_a]], of_b[good[unit_b]]
        place = np.flatnonzero(good)
        n_a, n_b, ids_a, ids_b = n_a[good], n_b[good], of_a.tolist(), of_b.tolist()
        ends_a, ends_b = np.cumsum(self.a_size[of_a]), np.cumsum(self.b_size[of_b])
        found = np.array(groups(labels(int(ends_a[-1]) if len(ends_a) else 0, ends_a, ends_b)), np.int64).reshape(-1, 2)
        first = np.cumsum(found, axis=0) - found
        unit = place[np.searchsorted(np.cumsum(n_a), first[:, 0], "right")]  # of each group
        links = found[:, 0] * found[:, 1]
        counts = np.zeros((len(units), 4), np.int64)
        counts[place, 0], counts[place, 1] = n_a, n_b
        counts[:, 2] = np.bincount(unit, minlength=len(units))
        np.add.at(counts[:, 3], unit, links)

        text_a, text_b = list(map(str, ids_a)), list(map(str, ids_b))
        said = [text_a[i] + "|" + text_b[j] if m == n == 1 else ",".join(text_a[i : i + m]) + "|" + ",".join(text_b[j : j + n]) for (i, j), (m, n) in zip(first.tolist(), found.tolist(), strict=True)]
        bounds = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        self.said += [";".join(said[x:y]) if ok else None for x, y, ok in zip(bounds[:-1], bounds[1:], good.tolist(), strict=True)]

        small = np.flatnonzero(links <= 1 << 12)
        each = np.repeat(small, links[small])
        at = np.arange(len(each)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        width = found[each, 1]
        key = [unit[each] * len(self.a_size) * len(self.b_size) + of_a[first[each, 0] + at // width] * len(self.b_size) + of_b[first[each, 1] + at % width]]
        times = [np.ones(len(each), np.int64)]
        for g in np.flatnonzero(links > 1 << 12).tolist():  # by distinct ids of either side, with how often they occur
            (x, m), (y, n) = (np.unique(of[i : i + k], return_counts=True) for of, i, k in zip((of_a, of_b), first[g].tolist(), found[g].tolist(), strict=True))
            key.append((unit[g] * len(self.a_size) * len(self.b_size) + x[:, None] * len(self.b_size) + y).ravel())
            times.append((m[:, None] * n).ravel())
        key, inverse = np.unique(np.concatenate(key), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, np.concatenate(times))
        of, key = key // (len(self.a_size) * len(self.b_size)), key % (len(self.a_size) * len(self.b_size))
        self.known.update(zip(units, range(len(self.counts), len(self.counts) + len(units)), strict=True))
        self.counts = np.concatenate([self.counts, counts])
        self.width = np.concatenate([self.width, np.bincount(of, minlength=len(units))])
        self.pairs = np.concatenate([self.pairs, key // len(self.b_size) << 32 | key % len(self.b_size)])
        self.links = np.concatenate([self.links, total])

    def _uneven(self, raw: list[bytes], unit_a: np.ndarray, of_a: np.ndarray, unit_b: np.ndarray, of_b: np.ndarray) -> bool:
        """Whether some unit's tokens are longer or shorter than it."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        return any((np.bincount(unit, size[of], len(raw)) != sizes).any() for unit, size, of in ((unit_a, self.a_size, of_a), (unit_b, self.b_size, of_b)))

    def block(self, texts: list[str]) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Each text's counts and digest; the distinct id pairs; the number of texts with each; postings of (text, pair, links)."""
        if len(self.known) > REMEMBER:
            self.forget()
        cut = [self.units(text) if text else [] for text in texts]
        new = list(set().union(*cut) - self.known.keys())
        for at in range(0, len(new), 1 << 13):
            self.learn(new[at : at + (1 << 13)])
        known, unit = np.unique(np.array([self.known[u] for own in cut for u in own], np.int64), return_inverse=True)
        sizes = np.array(list(map(len, cut)), np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        said = [self.said[k] for k in known.tolist()]
        good = np.array([x is not None for x in said], bool)
        whole = sizes > 0
        whole[doc[~good[unit]]] = False
        unit, doc = unit[whole[doc]], doc[whole[doc]]
        sums = np.zeros((len(texts), 4), np.int64)
        np.add.at(sums, doc, self.counts[known[unit]])
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        order = unit.tolist()
        digest = [hashlib.sha256(";".join([said[u] for u in order[a:b]]).encode()).hexdigest() if w else "" for a, b, w in zip(bounds[:-1], bounds[1:], whole.tolist(), strict=True)]

        width = self.width[known]
        start = (np.cumsum(self.width) - self.width)[known]
        each, times = np.unique(doc * max(1, len(known)) + unit, return_counts=True)
        doc, unit = each // max(1, len(known)), each % max(1, len(known))
        size = width[unit]
        at = np.repeat(start[unit] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pairs, pair = np.unique(self.pairs[at], return_inverse=True)
        key, inverse = np.unique(np.repeat(doc, size) * max(1, len(pairs)) + pair, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, np.repeat(times, size) * self.links[at])
        doc, pair = key // max(1, len(pairs)), key % max(1, len(pairs))
        return {**{c: sums[:, k] for k, c in enumerate(COUNTS)}, "groups_sha256": digest}, pairs, np.bincount(pair, minlength=len(pairs)), (doc, pair, total)


def _shrunk(*arrays: pa.Array) -> bytes:
    """Arrays of one length, compressed."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(list(arrays), [str(k) for k in range(len(arrays))])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _grown(data: pa.Scalar) -> list[pa.Array]:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch().columns


def align(df: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. byte_level, pieces: paths of the tokenizers' files, readable on every executor."""
    small_batches(df.sparkSession, 4000)
    id_type = df.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, pieces)
        for whole in batches:
            for batch in slices(whole, "text", block):
                own, pairs, held, (doc, pair, links) = aligner.block([t or "" for t in batch.column("text").to_pylist()])
                texts = _shrunk(batch.column("doc_id"), *(pa.array(own[c]) for c in COUNTS), pa.array(own["groups_sha256"]))
                postings = _shrunk(pa.array(doc.astype(np.uint32)), pa.array(pair.astype(np.uint32)), pa.array(links))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([texts], pa.binary()), pa.array([postings], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64()))], ["texts", "postings", "pairs", "held"]
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, postings, known in zip(batch.column("texts"), batch.column("postings"), batch.column("known"), strict=True):
                ids, *own, digest = _grown(texts)
                doc, pair, links = (c.to_numpy() for c in _grown(postings))
                best, sums = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                if len(pair):
                    place, docs, top = (known.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "docs", "top"))
                    count, is_top = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
                    count[place], is_top[place] = docs, top
                    np.add.at(best, doc, links * is_top[pair])
                    np.add.at(sums, doc, links * count[pair])
                yield pa.RecordBatch.from_arrays([ids, *own, pa.array(best), pa.array(sums), digest], ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = written(rows.mapInArrow(scan, "texts binary, postings binary, pairs array<long>, held array<long>").withColumn("block", F.monotonically_increasing_id()), "alignments")
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "of")).select("block", "at", F.col("of.pairs").alias("pair"), F.col("of.held").alias("held"))
    counts = written(each.groupBy("pair").agg(F.sum("held").alias("docs")), "pair-counts")
    id_a = F.shiftright("pair", 32)
    best = counts.groupBy(id_a.alias("id_a")).agg(F.max("docs").alias("most"))  # a row for each id of A's vocabulary at most
    judged = counts.join(F.broadcast(best), id_a == F.col("id_a")).select(F.col("pair").alias("__pair"), "docs", (F.col("docs") == F.col("most")).alias("top"))
    judged = written(judged, "judged-pairs")  # a table of its own, so that the join reads two plain exchanges
    known = each.join(judged, F.col("pair") == F.col("__pair")).groupBy("block").agg(F.collect_list(F.struct("at", "docs", "top")).alias("known")).withColumnRenamed("block", "__block")
    made = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])
    return blocks.select("block", "texts", "postings").join(known, F.col("block") == F.col("__block"), "left").select("texts", "postings", "known").mapInArrow(total, made)
