"""Embedding whitening by mixed-precision refinement.

Vectors are put on an integer grid (``floor(64 * c) + 1000000``) and the distinct
ones are the fit list.  Its covariance is exact: a first pass sums each dimension,
a second one sums the products of the vectors centred on the rounded mean, both in
whole numbers (matrix products of integers that a double holds exactly), and the
shift between rounded and true mean is taken off in whole numbers as well.  The sums
therefore do not depend on how Spark deals out the rows.  A task hands on one row of
sums a dimension; the rows of a dimension meet in a stream, and the driver gets the
d x d sums only (its size is the square of the vectors' length, whatever the table's).

The eigenvectors start as those of the covariance in float32.  Each round of the
Ogita-Aishima iteration measures, in extended precision and with matrix products only,
how far they are from orthonormal (R) and from diagonalising (S), and corrects them by
first-order perturbation, which squares the error.  Pairs of eigenvalues closer than
the error bound of the round can't be corrected that way: such a cluster's own small
problem is solved on its own span, shifted by its mean, and its vectors are turned
accordingly; the next rounds then see its eigenvalues apart.

``identity_error`` is measured, not assumed: one more pass over the fit list takes the
covariance of the whitened vectors, centred before multiplying, with means and products
merged pairwise.

Defined results: a row whose vector is null, or holds null, NaN, infinite entries or
entries of 2**40 or more, has no result, nor has one whose length is not that of most
vectors (ties: the longer); components whose eigenvalue is zero to double precision
(relative to the largest) are left out, so a table of one distinct vector, of empty
vectors or without rows gives an empty result; repeated rows and null ids are returned
as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)   # entries from here on have no place on the grid
_LIMBS = 5                 # 32-bit parts of the whole numbers that tasks hand on
_ROUNDS = 16
_MERGERS = 16


def on_grid(vectors: DataFrame, vector: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``k0, k1, ...`` (the keys) and ``x`` (array of long) of every usable row."""
    v = F.col(f"`{vector}`")
    usable = v.isNotNull() & F.forall(
        v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < LARGEST))
    x = F.transform(v, lambda e: F.floor(e.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return vectors.where(usable).select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], x.alias("x"))


def _matrix(batch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


# ------------------------------------------------------- exact sums over tasks
def _to_limbs(row: np.ndarray) -> np.ndarray:
    return np.array([[(v >> 32 * k) & 0xFFFFFFFF if k < _LIMBS - 1 else v >> 32 * k for v in row]
                     for k in range(_LIMBS)], dtype=np.int64).ravel()


def _from_limbs(limbs: np.ndarray) -> np.ndarray:
    parts = limbs.reshape(_LIMBS, -1).astype(object)
    return sum(parts[k] << 32 * k for k in range(_LIMBS))


_SUMS = "i int, limbs array<long>"


def _sum_batch(rows: list[tuple[int, np.ndarray]]):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()),
                                       pa.array([limbs for _, limbs in rows], pa.list_(pa.int64()))],
                                      names=["i", "limbs"])


def _exact_sum(table: DataFrame, part, height: int) -> np.ndarray:
    """Sum over all batches of the ``height`` rows of whole numbers that ``part`` makes of a batch."""
    def first(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(batch)
                total = one if total is None else total + one
        if total is not None:
            for i, row in enumerate(total):
                yield _sum_batch([(i, _to_limbs(row))])

    def merge(batches):
        now, total = None, None
        for batch in batches:
            for i, limbs in zip(batch.column("i").to_pylist(), batch.column("limbs")):
                row = limbs.values.to_numpy()
                if i != now:
                    if now is not None:
                        yield _sum_batch([(now, total)])
                    now, total = i, np.zeros(len(row), np.int64)
                total = total + row
        if now is not None:
            yield _sum_batch([(now, total)])

    sums = (table.mapInArrow(first, _SUMS).repartition("i").sortWithinPartitions("i")
            .mapInArrow(merge, _SUMS).toArrow())
    out: list = [None] * height
    for i, limbs in zip(sums.column("i").to_pylist(), sums.column("limbs")):
        out[i] = _from_limbs(limbs.values.to_numpy())
    return np.array(out, dtype=object)


def exact_gram(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` of whole numbers, exactly, as Python integers."""
    room = (53 - len(z).bit_length()) // 2      # parts of so many bits keep every sum below 2**53
    parts, rest = [], z
    while int(np.abs(rest).max(initial=0)).bit_length() > room:
        parts.append(rest & ((1 << room) - 1))
        rest = rest >> room
    parts.append(rest)
    parts = [p.astype(np.float64) for p in parts]
    total = np.zeros((z.shape[1],) * 2, dtype=object)
    for a, one in enumerate(parts):
        for b, other in enumerate(parts):
            total = total + ((one.T @ other).astype(np.int64).astype(object) << room * (a + b))
    return total


# -------------------------------------------------------------- eigenvectors
def _extended(numerator: int, denominator: int) -> np.longdouble:
    whole, rest = divmod(numerator, denominator)
    high = float(whole)
    return (np.longdouble(high) + np.longdouble(float(whole - int(high)))
            + np.longdouble(float(rest)) / np.longdouble(float(denominator)))


def _spread(m: np.ndarray) -> float:
    return float(np.linalg.norm(m.astype(np.float64), 2)) if m.size else 0.0


@dataclass
class Refinement:
    """What the iteration did: rounds, largest correction of each, clusters solved on their own."""
    corrections: list
    clusters: int


def _clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(a: np.ndarray, rounds: int = _ROUNDS) -> tuple[np.ndarray, np.ndarray, Refinement]:
    """(falling eigenvalues, unit eigenvectors as columns, what was done) of a symmetric matrix."""
    a = a.astype(np.longdouble)
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(len(a), np.longdouble), np.eye(len(a), dtype=np.longdouble), Refinement([], 0)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    done, one = Refinement([], 0), np.eye(len(a), dtype=np.longdouble)
    small = 8 * len(a) * np.finfo(np.longdouble).eps
    norm = _spread(a)
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        bound = 2 * (_spread(s - np.diag(values)) + norm * _spread(r))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > bound
        e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ e
        done.corrections.append(float(np.abs(e).max()))
        if bound > small:
            for c in _clusters(values, bound):
                own = x[:, c]
                gram = own.T @ own
                own = own + own @ ((np.eye(len(c), dtype=np.longdouble) - gram) / 2)
                inner = own.T @ (a @ own) - values[c].mean() * (own.T @ own)
                scale = np.abs(inner).max()
                if scale > 0:
                    inner = (inner / scale).astype(np.float64)
                    own = own @ np.linalg.eigh((inner + inner.T) / 2)[1].astype(np.longdouble)
                    done.clusters += 1
                x[:, c] = own
        elif done.corrections[-1] <= small:
            break
        if len(done.corrections) > 3 and done.corrections[-1] < 1e-15 and (
                done.corrections[-1] >= done.corrections[-2] / 2):
            break
    for _ in range(2):      # rounding errors of close pairs leave vectors a little oblique
        x = x + x @ ((one - x.T @ x) / 2)
    values = (x * (a @ x)).sum(axis=0) * size
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return values[order], x * sign, done


# ------------------------------------------------------------------- the model
@dataclass
class Whitener:
    """Fitted whitening: ``(z - shift) @ turn`` of ``z = x - centre``."""
    n: int
    centre: np.ndarray          # rounded mean of each dimension (integers)
    sums: np.ndarray            # sums of x - centre (Python integers)
    values: np.ndarray          # eigenvalues of the components
    vectors: np.ndarray         # components, as columns
    trace: float
    refinement: Refinement

    @property
    def turn(self) -> np.ndarray:
        return (self.vectors / np.sqrt(self.values)).astype(np.float64)

    @property
    def shift(self) -> np.ndarray:
        return np.array([float(_extended(int(s), self.n)) for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.shift) @ self.turn

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of ``(n * x - S) ** 2``, exactly."""
        z = x - self.centre
        most = int(np.abs(z).max(initial=0)) * self.n + max((abs(int(s)) for s in self.sums), default=0)
        if most * most * max(1, z.shape[1]) < 1 << 62:
            return ((z * self.n - self.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return ((z.astype(object) * self.n - self.sums) ** 2).sum(axis=1).tolist()


def usual_length(grid: DataFrame) -> int:
    """Length of most vectors (ties: the longer); 0 without rows."""
    top = (grid.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
           .orderBy(F.desc("rows"), F.desc("d")).limit(1).collect())
    return top[0]["d"] if top else 0


def fit(fit_list: DataFrame, dimensions: int, components: int) -> Whitener | None:
    """Whitener of a table of distinct vectors ``x``; None if there is nothing to whiten."""
    if not dimensions:
        return None
    total = _exact_sum(fit_list, lambda b: np.array(
        [[b.num_rows] + [int(v) for v in _matrix(b).sum(axis=0)]], dtype=object), 1)
    if total[0] is None or not len(total[0]):
        return None
    n, sums = int(total[0][0]), total[0][1:]
    whole = [(2 * int(s) + n) // (2 * n) for s in sums]
    centre = np.array(whole, dtype=np.int64)
    gram = _exact_sum(fit_list, lambda b: exact_gram(_matrix(b) - centre), dimensions)
    rest = np.array([int(s) - n * c for s, c in zip(sums, whole)], dtype=object)
    moments = n * gram - np.outer(rest, rest)
    covariance = np.array([[_extended(int(v), n * n) for v in row] for row in moments], dtype=np.longdouble)
    values, vectors, done = eigen(covariance)
    zero = len(values) * np.finfo(np.float64).eps * float(values[0])
    kept = min(components, int((values > zero).sum()))
    return Whitener(n, centre, rest, values[:kept], vectors[:, :kept], float(np.trace(covariance)), done) if kept else None


def _merged(a, b):
    """Counts, means and centred products of two parts together."""
    if a is None:
        return b
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


_MOMENTS = "part int, moments array<double>"


def identity_error(fit_list: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    m = len(model.values)

    def packed(part, total):
        flat = np.concatenate([[total[0]], total[1], total[2].ravel()])
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([flat], pa.list_(pa.float64()))],
                                          names=["part", "moments"])

    def first(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch))
                mean = w.mean(axis=0)
                total = _merged(total, (float(len(w)), mean, (w - mean).T @ (w - mean)))
        if total is not None:
            yield packed(TaskContext.get().partitionId(), total)

    def unpacked(flat):
        return float(flat[0]), flat[1:1 + m], flat[1 + m:].reshape(m, m)

    def merge(batches):
        total = None
        for batch in batches:
            for row in batch.column("moments"):
                total = _merged(total, unpacked(row.values.to_numpy()))
        if total is not None:
            yield packed(0, total)

    # in the order of the parts: floating-point sums depend on it
    rows = (fit_list.mapInArrow(first, _MOMENTS).repartition(_MERGERS, "part").sortWithinPartitions("part")
            .mapInArrow(merge, _MOMENTS).toArrow())
    total = None
    for row in rows.column("moments"):
        total = _merged(total, unpacked(row.values.to_numpy()))
    return float(np.abs(total[2] / total[0] - np.eye(m)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", keys: tuple[str, ...] = ("vec_id",),
           components: int = 16) -> DataFrame:
    """One row per usable row of ``vectors`` and component (from 1, by falling eigenvalue): the keys,
    ``component, n, deviation`` (decimal)``, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    grid = on_grid(vectors, vector, keys)
    dimensions = usual_length(grid)
    fit_list = stored(grid.where(F.size("x") == dimensions).select("x").distinct(), "whitening-fit")
    model = fit(fit_list, dimensions, components)
    kinds = {f"k{i}": vectors.schema[k].dataType.simpleString() for i, k in enumerate(keys)}
    own = ("component int, n long, deviation decimal(38,0), whitened double, explained double, "
           "identity_error double")
    schema = ", ".join([*(f"{k} {t}" for k, t in kinds.items()), own])
    if model is None:
        out = spark.createDataFrame([], schema)
    else:
        error = identity_error(fit_list, model)
        explained = np.array([float(v) / model.trace for v in model.values])

        def run(batches):
            m = len(model.values)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch)
                again = pa.array(np.repeat(np.arange(batch.num_rows), m))
                count = m * batch.num_rows
                deviation = pa.array([Decimal(v) for v in model.deviation(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(again) for k in kinds),
                     pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), batch.num_rows)),
                     pa.array(np.full(count, model.n, np.int64)), deviation.take(again),
                     pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, batch.num_rows)),
                     pa.array(np.full(count, error))],
                    names=[*kinds, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        out = grid.where(F.size("x") == dimensions).mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "component", "n", "deviation", "whitened",
                      "explained", "identity_error")
