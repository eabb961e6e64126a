"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz.

Entries become whole numbers (floor of `SCALE` times the entry, plus `SHIFT`), so that counts and sums are exact. A pass
over all centred rows multiplies their covariance with a basis: each task adds up its rows' part, a sum a dimension is
shuffled and added, and the driver gets a matrix of the vectors' dimension times the basis' width, whatever the number
of rows. The basis starts as random directions, `OVERSAMPLE` more than the components wanted, and each pass makes it the
covariance's image of itself, orthonormal again. Rayleigh-Ritz in the basis gives eigenvalues and components, and the
same pass their residuals. When these vanish (up to `TOLERANCE` of the largest eigenvalue) the passes end. If they don't
within `PASSES`, as in a flat spectrum, the basis is completed to the full dimension, where one more pass is exact.

Defined results: rows whose vector is null or holds a null or non-finite entry, or one of 2**46 or more, which has no
whole number to become, are dropped; so are vectors of another length than the most frequent (of equally frequent
ones the longest) and empty ones. A null or repeated id stays as it is, and repeated rows count each. Components of no
variance (eigenvalue up to `NOTHING` of the trace) can't be whitened and are left out, so that equal rows, or a single
one, give no rows, nor does an empty table. Components of equal eigenvalues are any orthonormal ones of their space. A
deviation that no long holds is null. Columns other than id and vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import small_batches, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Random directions beyond the components wanted, and passes before the basis is completed.
OVERSAMPLE, PASSES = 16, 4
#: Residuals, as a share of the largest eigenvalue, and eigenvalues, as a share of the trace, that count as none.
TOLERANCE, NOTHING = 1e-13, 1e-13
SEED = 12


@dataclass
class Centre:
    """Exact counts of the rows: their number, each dimension's sum, and the largest distance from the sums' whole means."""

    n: int
    sums: np.ndarray
    reach: int

    @property
    def whole(self) -> np.ndarray:
        return self.sums // max(1, self.n)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the whole part exactly, then what is left of it."""
        return (x - self.whole) - (self.sums - self.n * self.whole) / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n x - S) squared, exact."""
        near, rest = x - self.whole, self.sums - self.n * self.whole
        if (self.n * (self.reach + 1)) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return pa.array(((self.n * near - rest) ** 2).sum(axis=1))
        exact = ((self.n * near.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, size)


def rows_of(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that count, and the length of x."""
    entry = F.col("entries")
    vectors = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("entries"))
    good = entry.isNotNull() & ~F.exists(entry, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= float(1 << 46)))
    sizes = vectors.filter(good).groupBy(F.size(entry).alias("size")).count().filter("size > 0").orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    kept = vectors.filter(good & (F.size(entry) == size)) if size else vectors.filter(F.lit(False))
    return written(kept.select("vec_id", F.transform(entry, lambda e: F.floor(e * SCALE) + F.lit(SHIFT).cast("long")).alias("x")), "whole-vectors"), size


def centre_of(rows: DataFrame, size: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, least, most = 0, np.zeros(size, np.int64), None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, size)
                n, sums = n + len(x), sums + x.sum(axis=0)
                least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
                most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, n)), pa.array(sums), pa.array(least), pa.array(most)], ["dim", "n", "total", "least", "most"])

    parts = rows.select("x").mapInArrow(run, "dim int, n long, total long, least long, most long")
    found = sorted(parts.groupBy("dim").agg(F.sum("n"), F.sum("total"), F.min("least"), F.max("most")).collect())  # a row a dimension
    if not found:
        return Centre(0, np.zeros(size, np.int64), 0)
    sums = np.array([r[2] for r in found], np.int64)
    whole = sums // found[0][1]
    return Centre(found[0][1], sums, int(max(max(r[4] - w, w - r[3]) for r, w in zip(found, whole.tolist(), strict=True))))


def product(rows: DataFrame, size: int, centre: Centre, sides: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum over all rows of left times right, of sides(centred rows); a matrix of a few thousand by a few thousand at most."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                left, right = sides(centre.centred(_matrix(batch, size)))
                more = left.T @ right
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["dim", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, sums in zip(batch.column("dim").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                totals[dim] = totals.get(dim, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["dim", "sums"])

    parts = rows.select("x").mapInArrow(part, "dim int, sums binary")
    added = parts.repartition("dim").mapInArrow(add, "dim int, sums binary").collect()
    return np.stack([np.frombuffer(r.sums) for r in sorted(added)])


@dataclass
class Fit:
    """Eigenvalues by falling size, components as columns, the trace; passes over the rows, and whether the basis was completed."""

    values: np.ndarray
    components: np.ndarray
    trace: float
    passes: int
    completed: bool


def fit(rows: DataFrame, size: int, centre: Centre, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Fit:
    """The leading components of the rows' covariance (divisor n)."""
    rng = np.random.default_rng(SEED)
    wanted = min(size, components)
    basis = np.linalg.qr(rng.standard_normal((size, min(size, components + oversample))))[0]
    done = 0
    while True:
        done += 1
        q = basis

        def sides(centred: np.ndarray, q: np.ndarray = q) -> tuple[np.ndarray, np.ndarray]:
            return centred, centred @ q

        image = product(rows, size, centre, sides) / centre.n
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found = q @ turn
        residual = np.linalg.norm(image @ turn[:, :wanted] - found[:, :wanted] * values[:wanted], axis=0).max()
        full = q.shape[1] == size
        if full or residual <= TOLERANCE * max(values[0], 0.0):
            break
        if done < passes:
            basis = np.linalg.qr(image)[0]
        else:  # the range is not found: all dimensions
            basis = np.linalg.qr(np.concatenate([found, rng.standard_normal((size, size - q.shape[1]))], axis=1))[0]
    squares = product(rows, size, centre, lambda centred: (np.ones((len(centred), 1)), centred**2))
    trace = float(squares.sum()) / centre.n
    keep = values[:wanted] > NOTHING * trace
    return Fit(values[:wanted][keep], found[:, :wanted][:, keep], trace, done, full and components + oversample < size)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    small_batches(df.sparkSession)
    rows, size = rows_of(df, id_col, vector_col)
    id_type = df.schema[id_col].dataType
    made = T.StructType([T.StructField("vec_id", id_type), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    centre = centre_of(rows, size) if size else None
    if centre is None or centre.n == 0:
        return df.sparkSession.createDataFrame([], made)
    model = fit(rows, size, centre, components)
    count = len(model.values)
    if not count:
        return df.sparkSession.createDataFrame([], made)
    project = model.components / np.sqrt(model.values)

    def both(centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        white = np.concatenate([centred @ project, np.ones((len(centred), 1))], axis=1)
        return white, white

    moments = product(rows, size, centre, both) / centre.n
    mean = moments[:count, count]
    error = float(np.abs(moments[:count, :count] - np.outer(mean, mean) - np.eye(count)).max())
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, size)
            of = np.repeat(np.arange(len(x)), count)
            where = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(where), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(of), centre.n)), centre.deviations(x).take(where),
                    pa.array((centre.centred(x) @ project).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(of), error)),
                ],
                [f.name for f in made],
            )

    return rows.mapInArrow(run, made)
