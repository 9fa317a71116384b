"""Embedding whitening by block Lanczos, without ever forming the covariance matrix.

Vectors are quantized once into longs, x = floor(64 c) + 1,000,000, and stored. All that is
known of their covariance V = XᵀX / n (X centred) is what a pass over them makes of a block of
directions Q: each task adds up (x - S/n) ((x - S/n)ᵀ Q), and Spark adds up the tasks' rows, one a
dimension. Block Lanczos builds an orthonormal basis from such passes:

* every new block is orthogonalised twice against the whole basis;
* directions that vanish (a breakdown: the space so far is invariant) are replaced by random
  ones, orthogonal to the basis, so that copies of multiple eigenvalues are found;
* Ritz pairs are judged by their residuals |Vy - θy|, which the passes' products give for the
  whole basis. When all wanted ones are small, one more random block is added, and they must
  stay as they are. A basis of all dimensions is exact;
* a last pass over the wanted vectors gives their Rayleigh quotients, and V is diagonalised
  within their span once more.

Centring happens before multiplying, row by row, with the exact mean S/n. The trace is the sum
of exact integer deviations. The driver holds dimensions × basis numbers.

Defined cases: vectors that are null or hold null or non-finite entries are left out. So are
vectors of another length than most have (of two equally frequent lengths the larger counts;
empty ones never do) and, as x is a long and n·x - S must be one, vectors with an entry beyond
±2^40. Components with an eigenvalue up to 1e-12 of the largest carry no spread and are left
out, so rows that are all alike give no rows, as does an empty table. Repeated rows count each;
null ids stay; other columns play no part. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code, stored

COMPONENTS, BLOCK = 32, 8
#: Residuals count as none up to so much of the largest eigenvalue.
TOLERANCE = 1e-12
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**40
_LONG = (1 << 63) - 1


def quantized(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and x of the vectors that count (stored), and their length."""
    ship_code(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    x = F.transform(v, lambda c: F.floor(c * SCALE) + OFFSET)
    kept = stored(vectors.where((F.size(v) > 0) & fine).select("vec_id", x.alias("x")), "whitening")
    most = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return kept.where(F.size("x") == d), d


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


class Passes:
    """Passes over the stored vectors."""

    def __init__(self, table: DataFrame, d: int):
        self.table, self.d = table, d
        sums = self._summed(lambda x: np.hstack([x.sum(0)[:, None], np.full((d, 1), len(x))]), 2, "long")
        self.n = int(sums[0][1]) if sums else 0
        self.s = [int(r[0]) for r in sums]
        #: What centring subtracts: whole and fraction, so that n·x - S loses nothing.
        self.whole = np.array([s // self.n for s in self.s], np.int64)
        self.fraction = np.array([s % self.n / self.n for s in self.s])
        self.count = 0

    def _summed(self, of: Callable[[np.ndarray], np.ndarray], width: int, kind: str) -> list[list]:
        """Sum over batches of of(x), one row a dimension and width columns, added up in tasks first."""
        names = [f"c{k}" for k in range(width)]
        number = np.int64 if kind == "long" else np.float64
        out = pa.schema([("i", pa.int32()), *((c, pa.from_numpy_dtype(number)) for c in names)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    part = of(_rows(b)).astype(number)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(c) for c in total.T)], schema=out)

        parts = self.table.select("x").mapInArrow(run, f"i int, {', '.join(f'{c} {kind}' for c in names)}")
        got = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect()
        return [list(r)[1:] for r in sorted(got)]

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, fraction = self.whole, self.fraction
        return lambda x: (x - whole) - fraction

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        self.count += 1
        centred = self.centred()

        def of(x: np.ndarray) -> np.ndarray:
            z = centred(x)
            return z.T @ (z @ q)

        return np.array(self._summed(of, q.shape[1], "double"), float) / self.n

    def trace(self) -> float:
        """Sum of exact deviations, over n^3."""
        dev = deviations(self.n, self.s)
        n2 = float(self.n) ** 2
        got = self._summed(lambda x: np.array([[sum(map(int, dev(x))) / n2]]), 1, "double")
        return float(got[0][0]) / self.n

    def spread(self, y: np.ndarray) -> np.ndarray:
        """Covariance of the centred vectors projected on y's columns."""
        centred = self.centred()

        def of(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ y
            return np.vstack([w.T @ w, w.sum(0)])

        got = np.array(self._summed(of, y.shape[1], "double"), float) / self.n
        return got[:-1] - np.outer(got[-1], got[-1])


def deviations(n: int, s: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Of rows x, the exact sum over dimensions of (n x - S)^2, in longs where they surely fit."""
    total = np.array(s, object)

    def of(x: np.ndarray) -> np.ndarray:
        largest = max(abs(n * int(m) - t) for m, t in [*zip(x.max(0), s), *zip(x.min(0), s)])
        if largest <= 1 << 62 and max(map(abs, s)) <= _LONG and n * int(np.abs(x).max()) <= _LONG and largest * largest * len(s) <= _LONG:
            r = n * x - np.array(s, np.int64)
            return (r * r).sum(1)
        r = n * x.astype(object) - total
        return (r * r).sum(1)

    return of


def orthogonal(w: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """w's columns made orthonormal, to the basis too; those that vanish give way to random ones while there is room."""
    out = basis
    for k in range(min(w.shape[1], len(w) - basis.shape[1])):
        c, least = w[:, k], TOLERANCE * scale
        while True:
            before = np.linalg.norm(c)
            for _ in range(2):
                c = c - out @ (out.T @ c)
            if np.linalg.norm(c) > max(least, 1e-8 * before):
                break
            c, least = rng.standard_normal(len(w)), 0.0
        c = c / np.linalg.norm(c)
        c = c - out @ (out.T @ c)
        out = np.column_stack([out, c / np.linalg.norm(c)])
    return out[:, basis.shape[1] :]


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors of the symmetric d × d matrix behind times."""
    rng = np.random.default_rng(0)
    wanted = min(wanted, d)
    basis, products = np.zeros((d, 0)), np.zeros((d, 0))
    new = orthogonal(rng.standard_normal((d, min(block, d))), basis, rng, 1.0)
    sure: np.ndarray | None = None
    while True:
        made = times(new)
        basis, products = np.column_stack([basis, new]), np.column_stack([products, made])
        inner = basis.T @ products
        theta, s = np.linalg.eigh((inner + inner.T) / 2)
        theta, s = theta[::-1][:wanted], s[:, ::-1][:, :wanted]
        y = basis @ s
        residual = np.linalg.norm(products @ s - y * theta, axis=0)
        scale = max(theta[0], 0.0)
        if basis.shape[1] == d or scale == 0:
            if basis.shape[1] == d:
                break
            new = orthogonal(rng.standard_normal((d, block)), basis, rng, 1.0)
            continue
        if len(theta) == wanted and (residual <= TOLERANCE * scale).all():
            if sure is not None and np.abs(theta - sure).max() <= TOLERANCE * scale:
                break
            sure = theta
            new = orthogonal(rng.standard_normal((d, block)), basis, rng, 1.0)
        else:
            sure = None
            new = orthogonal(made - basis @ (basis.T @ made), basis, rng, scale)
    y, _ = np.linalg.qr(y)
    made = times(y)
    inner = y.T @ made
    theta, s = np.linalg.eigh((inner + inner.T) / 2)
    return theta[::-1], (y @ s)[:, ::-1]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector that counts."""
    table, d = quantized(vectors)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = vectors.sparkSession.createDataFrame([], schema)
    if not d:
        return empty
    p = Passes(table, d)
    e, y = block_lanczos(p.times, d, components)
    some = e > TOLERANCE * max(e[0], 0.0)
    if e[0] <= 0 or not some.any():
        return empty
    e, y = e[some], y[:, some]
    y = y / np.sqrt(e)
    explained = e / p.trace()
    error = float(np.abs(p.spread(y) - np.eye(len(e))).max())
    n, k, centred, dev = p.n, len(e), p.centred(), deviations(p.n, p.s)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _rows(b)
                deviation = pa.array([int(v) if v <= _LONG else None for v in dev(x)], pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), k))
                whitened = (centred(x) @ y).ravel()
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), deviation.take(each),
                    pa.array(whitened), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ], names=names)

    return table.select("vec_id", "x").mapInArrow(run, schema)
