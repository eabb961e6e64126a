"""Toxicity by a linear-chain conditional random field over words.

Labels say which documents are toxic, not which words. The labelled sample is therefore turned into labelled tokens in
rounds: a feature (a word, or its first 3 to 6 letters) marks words if its tokens stand in toxic documents far more often
than chance lets them (the likelihood ratio of the two rates; a document counts each feature `EACH` times at most); words
that are marked are then taken out, and what is left is judged again with smaller odds, so that `^pat` isn't marked for
what `pathetic` explains. A two-state chain is trained on these tokens by gradient ascent on their likelihood.
Forward-backward gives every word of a text its marginal; a document's score comes from the sum of the marginals that
stand out, through a logistic curve; it is fitted on sums that models of one half of the sample give the other half.
Words above one half make up the offending spans.

Only rows of the labels that aren't held out (crc32 of the id as text, modulo 4, is not 2) are learned from. Of them the
driver holds a bounded sample: of either class at most `most` rows in the order of a hash of id and text, whole texts,
ending with the row that brings the class to `most_bytes`; near copies among them count once. Scoring reads every whole
text, and the model, a table of weights of features that tell the classes apart, goes along with the function.

Defined results: a null or empty text has no words and gets the score of no evidence; without labels of both classes
every score is the share of toxic labels (0 without any), and `predicted` follows it, but `keep` drops nothing then;
an id with several labels is toxic if one of them says so; a null doc_id is not held out; a labelled id that repeats in
the documents gives each of its texts the label, within the bounds above; repeated rows get equal scores; an empty table
gives an empty result. Columns other than id and text are never read for a score.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import slices, small_batches, written

#: The sample's bounds, for either class: rows, and bytes of their texts.
MOST = 2000
MOST_BYTES = 64 << 20
THRESHOLD = 0.3
WORDS = r"[^\W\d_]+"
#: Log-odds from which a feature marks words, a round each; the documents that must have it; what one of them counts at most.
ODDS, SUPPORT, EACH = (4.0, 3.0, 2.0), 3, 4
#: Likelihood ratio from which a feature gets a weight.
TELLS = 6.0
#: Marginals below this are background.
STANDS_OUT = 0.1


def features(word: str) -> list[int]:
    """The word and its first letters, each as a 32-bit hash."""
    word = word.lower()
    return [zlib.crc32(f.encode()) for f in ["=" + word] + ["^" + word[:n] for n in range(3, 7) if len(word) >= n]]


def chain(odds: np.ndarray, begins: np.ndarray, step: np.ndarray, start: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over two states. odds: log-odds of state 1 at each place; begins: where sequences begin; step
    (2 x 2) and start (2): weights, not logs. Returns the marginals of state 1 and the expected moves (2 x 2).

    All sequences are one, with a step at each beginning that forgets what was before. It is cut into equal columns:
    products of the steps of each column, the few columns one after another, then all columns side by side."""
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    width = max(1, min(width, n))
    columns = -(-n // width)
    e = np.ones(columns * width)
    e[:n] = np.exp(np.clip(odds, -30, 30))
    new = np.ones(columns * width, bool)
    new[:n] = begins
    e, new = np.ascontiguousarray(e.reshape(columns, width).T), np.ascontiguousarray(new.reshape(columns, width).T)
    m00, m10 = np.where(new, start[0], step[0, 0]), np.where(new, start[0], step[1, 0])
    m01, m11 = np.where(new, start[1], step[0, 1]) * e, np.where(new, start[1], step[1, 1]) * e
    a, b, c, d = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)
    for t in range(width):
        a, b, c, d = a * m00[t] + b * m10[t], a * m01[t] + b * m11[t], c * m00[t] + d * m10[t], c * m01[t] + d * m11[t]
        s = a + b + c + d
        a, b, c, d = a / s, b / s, c / s, d / s
    into, out = np.empty((columns, 2)), np.empty((columns, 2))
    f0, f1 = 0.5, 0.5
    for r, (w, x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        into[r] = f0, f1
        f0, f1 = f0 * w + f1 * y, f0 * x + f1 * z
        f0, f1 = f0 / (f0 + f1), f1 / (f0 + f1)
    g0, g1 = 0.5, 0.5
    for r in range(columns - 1, -1, -1):
        out[r] = g0, g1
        g0, g1 = a[r] * g0 + b[r] * g1, c[r] * g0 + d[r] * g1
        g0, g1 = g0 / (g0 + g1), g1 / (g0 + g1)
    before, after = np.empty((width, columns)), np.empty((width, columns))  # shares of state 1 from the left and the right
    f1 = into[:, 1]
    for t in range(width):
        x, y = (1 - f1) * m00[t] + f1 * m10[t], (1 - f1) * m01[t] + f1 * m11[t]
        before[t] = f1 = y / (x + y)
    g1 = out[:, 1]
    for t in range(width - 1, -1, -1):
        after[t] = g1
        x, y = m00[t] * (1 - g1) + m01[t] * g1, m10[t] * (1 - g1) + m11[t] * g1
        g1 = y / (x + y)
    both = before * after
    p = (both / (both + (1 - before) * (1 - after))).T.ravel()[:n]
    left = np.concatenate([[0.5], before.T.ravel()[: n - 1]])
    right, e = after.T.ravel()[:n], e.T.ravel()[:n]
    moves = np.stack([(1 - left) * step[0, 0] * (1 - right), (1 - left) * step[0, 1] * e * right, left * step[1, 0] * (1 - right), left * step[1, 1] * e * right])
    moves = (moves / moves.sum(axis=0))[:, ~begins].sum(axis=1)
    return p, moves.reshape(2, 2)


class Model:
    def __init__(self, weights: dict[int, float], bias: float, step: np.ndarray, start: np.ndarray, curve: tuple[float, float]):
        self.weights, self.bias, self.step, self.start, self.curve = weights, bias, step, start, curve

    @property
    def blank(self) -> bool:
        """Whether nothing was learned: all texts get the same score, which tells none from another."""
        return not self.weights

    def odds(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, texts: list[str], known: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """The marginal of every word of all texts, and the number of words of each."""
        find = re.compile(WORDS).findall
        seen: dict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        places, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = [seen[w] for w in find(text)]
            places += own
            sizes[i] = len(own)
        if len(known) > 500_000:
            known.clear()
        each = np.zeros(len(seen))
        for w, i in seen.items():
            if (x := known.get(w)) is None:
                known[w] = x = self.odds(w)
            each[i] = x
        begins = np.zeros(len(places), bool)
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return chain(each[np.array(places, np.int64)], begins, self.step, self.start)[0], sizes

    def scores(self, sums: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(sums))))


def sums_of(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(of, np.where(p >= STANDS_OUT, p, 0.0), len(sizes))


def _once(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One of each group of near copies of a class: texts whose least hashes of three words in a row are the same four times."""
    from xxhash import xxh32_intdigest

    out = {}
    for text, toxic in rows:
        words = text.lower().split()
        runs = np.array([xxh32_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint32)
        least = tuple(int((runs * np.uint32(m)).min()) for m in (1, 2654435761, 2246822519, 3266489917))
        out.setdefault((least, toxic), (text, toxic))
    return list(out.values())


def train(rows: list[tuple[str, int]], base_rate: float, turns: int = 40) -> Model:
    """rows: (text, toxic), a sample of either class; base_rate: the share of toxic ones where it comes from."""
    rows = _once(rows)
    flat = Model({}, -20.0, np.full((2, 2), 0.5), np.array([0.5, 0.5]), (float(np.log(max(base_rate, 1e-6) / max(1 - base_rate, 1e-6))), 0.0))
    if len({y for _, y in rows}) < 2:
        return flat
    # toxic ones are dealt to both halves alike
    rows = [r for y in (0, 1) for r in rows if r[1] == y]
    halves = rows[::2], rows[1::2]
    sums, label = [], []
    for own, other in (halves, halves[::-1]):
        if (half := _train(own, turns)) is not None:
            for at in range(0, len(other), 200):
                sums.append(sums_of(*half.marginals([t for t, _ in other[at : at + 200]], {})))
            label += [y for _, y in other]
    model = _train(rows, turns)
    if model is None or len(set(label)) < 2:
        return flat
    model.curve = _curve(np.log1p(np.concatenate(sums)), np.array(label, float), base_rate)
    return model


def _curve(x: np.ndarray, label: np.ndarray, base_rate: float) -> tuple[float, float]:
    """A logistic curve by Newton's method, with a small pull to zero; classes count as much as where they come from."""
    share = label.mean()
    weight = np.where(label == 1, base_rate / share, (1 - base_rate) / (1 - share))
    a, b = 0.0, 1.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(weight * (label - q)).sum(), (weight * (label - q) * x).sum() - 0.05 * b])
        v = weight * q * (1 - q)
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.05]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(a), float(max(b, 0.0))


def _ratio(having: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts (class, feature) out of a total for each class: the likelihood ratio of unlike rates, and the log-odds."""
    both = having.sum(axis=0)
    fit = np.zeros(having.shape[1])
    for own, share in zip(having, total / total.sum(), strict=True):
        fit += own * np.log(np.maximum(own, 1e-300) / np.maximum(both * share, 1e-300))
    return 2 * fit, np.log((having[1] + 0.5) / (total[1] + 1)) - np.log((having[0] + 0.5) / (total[0] + 1))


def _train(rows: list[tuple[str, int]], turns: int) -> Model | None:
    """The chain alone, or nothing if no word stands out. Tokens are held as numbers of distinct words, features by word."""
    find = re.compile(WORDS).findall
    seen: dict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    own = [np.array([seen[w] for w in find(text)], np.int32) for text, _ in rows]
    toxic = np.array([y for _, y in rows], bool)
    each = [features(w) for w in seen]
    words = len(each)
    word = np.repeat(np.arange(words, dtype=np.int32), list(map(len, each)))
    names, feature = np.unique(np.array([f for x in each for f in x], np.int64), return_inverse=True)
    del each, seen
    marked, tells = np.zeros(words, bool), np.zeros(len(names), bool)
    for least in ODDS:
        having, documents, total = np.zeros((2, len(names))), np.zeros((2, len(names))), np.zeros(2)
        left = ~marked[word]
        first, left_feature = np.searchsorted(word[left], np.arange(words + 1)), feature[left]
        for ids, y in zip(own, toxic.astype(int).tolist(), strict=True):
            distinct, times = np.unique(ids, return_counts=True)
            n = first[distinct + 1] - first[distinct]
            at = np.repeat(first[distinct] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found, of = np.unique(left_feature[at], return_inverse=True)
            having[y, found] += np.minimum(np.bincount(of, np.repeat(times, n), len(found)), EACH)
            documents[y, found] += 1
            total[y] += len(ids)
        ratio, odds = _ratio(having, total)
        if least == ODDS[0]:
            tells = (ratio >= TELLS) & (documents.sum(axis=0) >= SUPPORT)
        marks = (documents[1] >= SUPPORT) & (odds >= least)
        marks &= ratio >= 2 * np.log(max(2, np.count_nonzero(documents[1] >= SUPPORT)))  # as many are tried
        marked |= np.bincount(word[left], marks[left_feature], words) > 0
        tells |= marks
    used = np.flatnonzero(tells)
    number = np.full(len(names), -1, np.int64)
    number[used] = np.arange(len(used))
    keep = number[feature] >= 0
    word, feature = word[keep], number[feature[keep]]
    # blocks of whole documents, to bound what forward-backward holds
    blocks, block, size = [], [], 0
    for k, ids in enumerate(own):
        if len(ids):
            block.append(k)
            size += len(ids)
        if block and size >= 300_000 or block and k == len(own) - 1:
            ids = np.concatenate([own[i] for i in block])
            begins = np.zeros(len(ids), bool)
            begins[np.cumsum([0] + [len(own[i]) for i in block[:-1]])] = True
            y = np.repeat(toxic[block], [len(own[i]) for i in block]) & marked[ids]
            blocks.append((ids, begins, y))
            block, size = [], 0
    if not any(y.any() for _, _, y in blocks):
        return None
    del own
    moved, total, tokens = np.zeros((2, 2)), 0, np.zeros(words)
    for ids, begins, y in blocks:
        pair = 2 * np.concatenate([[0], y[:-1]]) + y
        moved += np.bincount(pair[~begins], minlength=4).reshape(2, 2)
        tokens += np.bincount(ids, minlength=words)
        total += len(ids)
    # parameters: a weight for each feature, the bias, the log of the steps
    count = len(used)
    value, fast, slow = np.zeros(count + 5), np.zeros(count + 5), np.zeros(count + 5)
    value[count] = -4.0
    scale = np.concatenate([np.maximum(5, np.bincount(feature, tokens[word], count)), np.full(5, total)])
    start = np.array([0.5, 0.5])
    for turn in range(1, turns + 1):
        score = np.bincount(word, value[feature], words) + value[count]
        gap, moves = np.zeros(words), np.zeros((2, 2))
        for ids, begins, y in blocks:
            p, m = chain(score[ids], begins, np.exp(value[-4:]).reshape(2, 2), start)
            gap += np.bincount(ids, y - p, words)
            moves += m
        slope = np.concatenate([np.bincount(feature, gap[word], count) - 0.01 * value[:count], [gap.sum()], (moved - moves).ravel()]) / scale**0.5
        fast, slow = 0.9 * fast + 0.1 * slope, 0.99 * slow + 0.01 * slope**2
        value = value + 0.3 * (fast / (1 - 0.9**turn)) / (np.sqrt(slow / (1 - 0.99**turn)) + 1e-8)
        value[-4:] = np.clip(value[-4:], -8, 8)
    weights = {int(names[f]): float(value[i]) for i, f in enumerate(used) if abs(value[i]) > 1e-3}
    return Model(weights, float(value[count]), np.exp(value[-4:]).reshape(2, 2), start, (0.0, 1.0))


def held_out(column: Column) -> Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST, most_bytes: int = MOST_BYTES) -> Model:
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__toxic")).filter(F.col("__toxic").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    sizes = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    picked = None
    for k in (0, 1):
        # `most` ids, then `most` rows: ids that repeat among the documents bring no more
        ids = known.filter(F.col("__toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(most)
        part = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).orderBy(F.xxhash64("__id"), F.xxhash64("__text"), "__id", "__text").limit(most)
        part = part.select("__toxic", "__text", F.octet_length("__text").alias("__size"), F.monotonically_increasing_id().alias("__row"))
        picked = part if picked is None else picked.unionByName(part)
    sample = written(picked, "labelled-sample")
    last, used = {0: -1, 1: -1}, {0: 0, 1: 0}
    for r in sample.select("__toxic", "__row", "__size").orderBy("__toxic", "__row").collect():
        if used[r["__toxic"]] < most_bytes:
            last[r["__toxic"]] = r["__row"]
            used[r["__toxic"]] += r["__size"]
    taken = sample.filter(F.col("__row") <= F.when(F.col("__toxic") == 1, last[1]).otherwise(last[0]))
    rows = sorted((r["__toxic"], r["__row"], r["__text"]) for r in taken.collect())
    total = sum(sizes.values())
    return train([(t, y) for y, _, t in rows], sizes.get(1, 0) / total if total else 0.0)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, spans (code points of offending words, end exclusive)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        words = re.compile(WORDS)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                p, sizes = model.marginals(texts, known)
                sums = sums_of(p, sizes)
                ends = np.cumsum(sizes)
                spans = []
                for text, lo, hi, s in zip(texts, ends - sizes, ends, sums, strict=True):
                    own = np.flatnonzero(p[lo:hi] >= 0.5) if s else ()
                    if len(own):
                        wanted = set(own.tolist())
                        spans.append([{"start": m.start(), "stop": m.end()} for i, m in enumerate(words.finditer(text)) if i in wanted])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(sums), pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    made = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), *T._parse_datatype_string("spans array<struct<start:int,stop:int>>").fields])
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, made)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def keep(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose texts score below the threshold, with all their columns; all rows, if nothing was learned."""
    if model.blank:
        return df
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            for batch in slices(whole, text_col, 4 << 20):
                p, sizes = model.marginals([t or "" for t in batch.column(at).to_pylist()], known)
                yield batch.filter(pa.array(model.scores(sums_of(p, sizes)) < threshold))

    return df.mapInArrow(run, df.schema)
