"""Whitening of embeddings on their leading principal components, by Chebyshev-filtered subspace iteration.

The fit list is every distinct vector once, stored as matrices of many rows. The covariance V is never formed:
a pass multiplies it with a thin block Q, each task adding up its rows' (x - mean) (x - mean)'Q. A Chebyshev
polynomial of V, built by its three-term recurrence from such passes, damps the unwanted part of the
spectrum; then QR, and Rayleigh-Ritz by one more pass whose product starts the next polynomial. Iteration ends
when the residuals of the wanted pairs certify them, and a fresh random block, filtered in the space beside
them, finds no larger eigenvalue that was missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

#: Steps of the grid that components are put on before fitting.
STEPS = 256
#: Columns carried besides the wanted ones, degree of a polynomial, most polynomials.
GUARD, DEGREE, MOST = 28, 12, 400
#: Bound on a residual, as a share of the largest eigenvalue; eigenvalues below this share count as zero.
RESIDUAL, ZERO = 1e-13, 1e-11
#: Rows of a stored matrix.
ROWS = 4096


@dataclass
class Whitening:
    """Fitted map: mean and directions, exact sums over the fit list, and how good the fit is."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def on_grid(vectors: str | Column = "embedding") -> Column:
    """``floor(256 c)`` of every component as long; null for a vector that is null or holds null or non-finite ones."""
    doubles = (F.col(vectors) if isinstance(vectors, str) else vectors).cast("array<double>")
    sound = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(doubles.isNotNull() & sound, F.transform(doubles, lambda c: F.floor(c * STEPS).cast("long")))


def _largest(x: np.ndarray) -> int:
    """Largest magnitude, also where the smallest 64-bit integer is among the values."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _matrices(grid: DataFrame) -> DataFrame:
    """Distinct vectors of column ``x`` as matrices in the narrowest integer type that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def matrix():
            block = np.vstack(held)
            held.clear()
            kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or _largest(block) <= np.iinfo(t).max)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind]), pa.array([len(block)], pa.int64()), pa.array([block.astype(kind).tobytes()])],
                names=["kind", "rows", "block"],
            )

        for batch in batches:
            column = batch.column(0)
            if len(batch):
                held.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
            if sum(map(len, held)) >= ROWS:
                yield matrix()
        if held:
            yield matrix()

    return grid.select("x").distinct().mapInArrow(run, "kind string, rows long, block binary")


def _exact(block: np.ndarray) -> np.ndarray:
    """Python integers where sums of squares could leave 64 bits."""
    top = _largest(block)
    return block.astype(object) if top * top * (len(block) + 1) >= 1 << 62 else block.astype(np.int64)


class _FitList:
    """The stored matrices and the passes over them."""

    def __init__(self, matrices: DataFrame, d: int):
        self.matrices, self.d = matrices, d
        self.n, self.sums, squares = self._moments()
        n = self.n
        self.mean = np.array([s / n for s in self.sums]) if n else np.zeros(d)
        # n * sum of squares - square of the sum, in whole numbers: no cancellation
        self.trace = sum((n * q - s * s) / (n * n) for q, s in zip(squares, self.sums)) if n else 0.0

    def _moments(self) -> tuple[int, list[int], list[int]]:
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = _exact(np.frombuffer(row["block"], row["kind"]).reshape(-1, d))
                    values = [len(x), *x.sum(axis=0).tolist(), *(x * x).sum(axis=0).tolist()]
                    # two limbs, so that sums over any number of rows stay whole
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(range(len(values)), pa.int32()),
                            pa.array([v >> 31 for v in values], pa.decimal128(38, 0)),
                            pa.array([v & 0x7FFFFFFF for v in values], pa.decimal128(38, 0)),
                        ],
                        names=["cell", "high", "low"],
                    )

        sums = self.matrices.mapInArrow(run, "cell int, high decimal(38,0), low decimal(38,0)")
        rows = sums.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
        cells = {r["cell"]: (int(r["high"]) << 31) + int(r["low"]) for r in rows}
        values = [cells.get(k, 0) for k in range(2 * d + 1)]
        return values[0], values[1 : d + 1], values[d + 1 :]

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q: every task adds up its rows, Spark adds up the tasks' d x k sums cell by cell."""
        d, mean = self.d, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["block"], row["kind"]).reshape(-1, d) - mean
                    total += x.T @ (x @ q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(q.size), pa.int32()), pa.array(total.ravel())], names=["cell", "part"]
            )

        parts = self.matrices.mapInArrow(run, "cell int, part double")
        out = np.zeros(q.size)
        for row in parts.groupBy("cell").agg(F.sum("part").alias("part")).collect():
            out[row["cell"]] = row["part"]
        return out.reshape(q.shape) / self.n

    def second_moments(self, scale: np.ndarray) -> np.ndarray:
        """Covariance of (x - mean) scale over the fit list."""
        return scale.T @ self.times(scale)


def _filtered(times, q, vq, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of V on the block q (vq is V q): small on [low, cut], largest at ``top``."""
    middle, half = (cut + low) / 2, (cut - low) / 2
    sigma = half / (top - middle)
    first, tau = sigma, 2 / sigma
    before, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        sigma_next = 1 / (tau - first)
        now, before = (times(now) - middle * now) * (2 * sigma_next / half) - before * (first * sigma_next), now
        first = sigma_next
    return now


def leading_pairs(times, d: int, trace: float, k: int, rng=None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a positive semidefinite d x d operator and their vectors, certified.

    ``times`` multiplies the operator with a block. Pairs whose value is zero next to the largest are left out.
    """
    if not trace:
        return np.zeros((d, 0)), np.zeros(0)
    rng = rng or np.random.default_rng(0)
    width = min(d, k + GUARD)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    for _ in range(MOST):
        vq = times(q)
        values, turn = np.linalg.eigh(q.T @ vq)
        order = np.argsort(-values)
        values, q, vq = values[order], q @ turn[:, order], vq @ turn[:, order]
        top = values[0]
        wanted = int((values[:k] > ZERO * top).sum())
        residuals = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        if (residuals <= RESIDUAL * top).all():
            missed = _missed(times, q, values, wanted, trace, rng)
            if missed is None:
                return q[:, :wanted], values[:wanted]
            q = np.linalg.qr(np.hstack([missed, q]))[0][:, :width]
            continue
        cut = max(values[-1], ZERO * top)
        if cut >= top * (1 - 1e-12):  # all values alike: any basis of the block will do
            cut = top * (1 - 1e-6)
        q = np.linalg.qr(_filtered(times, q, vq, 0.0, cut, top, DEGREE))[0]
    raise RuntimeError("the leading components were not certified")


def _missed(times, q, values, wanted, trace, rng) -> np.ndarray | None:
    """Directions beside the block with a larger value than the last wanted one, None if there are none."""
    d, width = q.shape
    if width == d or trace - values.sum() < values[wanted - 1]:
        return None  # what is left of the trace is too little for another one

    def beside(b):
        return b - q @ (q.T @ b)

    probe = np.linalg.qr(beside(rng.standard_normal((d, min(4, d - width)))))[0]
    cut = max(values[-1], ZERO * values[0])
    probe = _filtered(lambda b: beside(times(b)), probe, beside(times(probe)), 0.0, cut, max(values[0], 1.01 * cut), DEGREE)
    probe = np.linalg.qr(beside(probe))[0]
    found, turn = np.linalg.eigh(probe.T @ times(probe))
    larger = found > values[wanted - 1] * (1 + 1e-12)
    return probe @ turn[:, larger] if larger.any() else None


def fit(vectors: DataFrame, components: int = 4, column: str = "embedding") -> Whitening | None:
    """Whitening on up to ``components`` directions; None where no vector can be used.

    The dimension is the one most vectors have (the larger of equal ones); vectors of another one, null ones
    and ones with null or non-finite components are left out. Directions of no variance are left out.
    """
    grid = vectors.select(on_grid(column).alias("x")).filter("size(x) > 0")
    lengths = grid.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    d = common["d"]
    listed = _FitList(durable(_matrices(grid.filter(F.size("x") == d))), d)
    q, values = leading_pairs(listed.times, d, listed.trace, components)
    scaled = q / np.sqrt(values)
    error = np.abs(listed.second_moments(scaled) - np.eye(len(values))).max(initial=0.0)
    return Whitening(listed.n, listed.sums, listed.mean, q, values, listed.trace, float(error))


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(vectors: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """One row per vector and direction: its whitened coordinate, and how far it lies from the mean.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, null where that is no 64-bit integer.
    Vectors that were left out of the fit give no rows; null and repeated ids are kept, each row on its own;
    extra columns are ignored; an empty table gives no rows.
    """
    d = len(model.sums) if model else 0
    fits = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        k = len(model.values)
        scale = model.vectors / np.sqrt(model.values)
        reach = max(map(abs, model.sums))
        for batch in batches:
            if not len(batch) or not k:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            top = model.n * _largest(x) + reach
            if d * top * top < 1 << 63:
                far = ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                far = ((model.n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1)
                far = [v if v < 1 << 63 else None for v in far]
            rows = len(x)
            columns = [
                np.repeat(np.array(batch.column(0).to_pylist(), object), k),
                np.tile(np.arange(1, k + 1), rows),
                np.full(rows * k, model.n),
                np.repeat(np.array(far, object), k),
                ((x - model.mean) @ scale).ravel(),
                np.tile(model.explained, rows),
                np.full(rows * k, model.identity_error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fits)], names=names)

    rows = vectors.select(F.col("vec_id").cast("long"), on_grid(column).alias("x")).filter(F.size("x") == d)
    if model is None:
        rows = rows.filter(F.lit(False))
    return rows.mapInArrow(run, SCHEMA)
