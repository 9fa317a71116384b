"""Background surfaces: fits with one-sided clipping, evaluation, and multiscale models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.stats import median_and_mad

MADN = 1.4826
CLIP, ROUNDS = 2.0, 3
SINGULAR = 1e-12
GROW, REJECT, FACTOR, ITERATIONS = 2, 3.0, 4, 5


def surface(coefficients: Column, degree: int, width: int, height: int) -> Column:
    """Basis [1, x, y] or [1, x, y, xx, xy, yy], positions over the size times 2 less 1."""
    x = F.col("x") / float(width) * 2 - 1
    y = F.col("y") / float(height) * 2 - 1
    basis = [F.lit(1.0), x, y] if degree == 1 else [F.lit(1.0), x, y, x * x, x * y, y * y]
    return sum((coefficients[i] * b for i, b in enumerate(basis[1:], 1)), coefficients[0] * basis[0])


def clip_high(points: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """points without those above median + 2 MADN, three times over; stops where the spread is nothing."""
    for _ in range(ROUNDS):
        s = median_and_mad(points, keys, value)
        sigma = F.lit(MADN) * F.col("mad")
        kept = points.join(s, keys).where((sigma <= 1e-12) | (F.col(value) <= F.col("median") + CLIP * sigma))
        points = kept.select(*points.columns)
    return points


def plane_fit(points: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Least-squares a + b x + c y per key from sums alone; null where singular."""
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col(value)
    s = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv"),
        F.covar_pop(x, x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, v).alias("xv"), F.covar_pop(y, v).alias("yv"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = F.abs(det) > 1e-12
    b = F.when(ok, (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det)
    c = F.when(ok, (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det)
    return s.select(*keys, "n", "mx", "my", "mv", b.alias("b"), c.alias("c")).select(*keys, "n", (F.col("mv") - F.col("b") * F.col("mx") - F.col("c") * F.col("my")).alias("a"), "b", "c")


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def eliminated(rows: Column, n: int) -> Column:
    """Augmented rows of a linear system in triangular form, by elimination with partial pivoting; null if a pivot is under SINGULAR.

    The pivot of a column is the first of its largest remaining entries.
    """

    def step(m: Column, col: Column) -> Column:
        size = F.transform(m, lambda row, r: F.when(r < col, -1.0).otherwise(F.abs(F.get(row, col))))
        swapped = let(
            (F.array_position(size, F.array_max(size)) - 1).cast("int"),
            lambda best: F.transform(m, lambda row, r: F.when(r == col, F.get(m, best)).when(r == best, F.get(m, col)).otherwise(row)),
        )
        below = lambda row, top: let(F.get(row, col) / F.get(top, col), lambda f: F.zip_with(row, top, lambda a, b: a - f * b))
        done = lambda m: let(F.get(m, col), lambda top: F.when(F.abs(F.get(top, col)) >= SINGULAR, F.transform(m, lambda row, r: F.when(r <= col, row).otherwise(below(row, top)))))
        return let(swapped, done)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, step)


def solved(rows: Column, n: int) -> Column:
    """The solution of n augmented rows as an array; null where eliminated() is."""

    def back(x: Column, r: Column, m: Column) -> Column:
        row = F.get(m, r)
        known = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.get(row, F.lit(n)), lambda s, k: F.when(k <= r, s).when(k < n, s - F.get(row, k) * F.get(x, k)).otherwise(s))
        return let(known / F.get(row, r), lambda v: F.transform(x, lambda old, k: F.when(k == r, v).otherwise(old)))

    zero = F.array(*[F.lit(0.0)] * n)
    return let(eliminated(rows, n), lambda m: F.when(m.isNotNull(), F.aggregate(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), zero, lambda x, r: back(x, r, m))))


def surface_fit(points: DataFrame, keys: list[str], degree: int, width: int, height: int, value: str = "v") -> DataFrame:
    """Coefficients per key; the normal equations are sums, each key's small system is solved as a fold over its rows."""
    x = F.col("x") / float(width) * 2 - 1
    y = F.col("y") / float(height) * 2 - 1
    basis = [F.lit(1.0), x, y] if degree == 1 else [F.lit(1.0), x, y, x * x, x * y, y * y]
    n = len(basis)
    at = {(i, j): f"_{min(i, j)}{max(i, j)}" for i in range(n) for j in range(n)}
    sums = [F.sum(basis[i] * basis[j]).alias(at[i, j]) for i in range(n) for j in range(i, n)] + [F.sum(b * F.col(value)).alias(f"_v{i}") for i, b in enumerate(basis)]
    rows = F.array(*(F.array(*(F.col(at[i, j]) for j in range(n)), F.col(f"_v{i}")) for i in range(n)))
    return points.groupBy(*keys).agg(*sums).select(*keys, solved(rows, n).alias("coefficients"))


def box_blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Rows then columns, window 2 r + 1, edges repeated."""
    for axis in (1, 0):
        p = np.pad(a, [(radius + 1, radius) if k == axis else (0, 0) for k in (0, 1)], mode="edge").cumsum(axis)
        hi = np.take(p, range(2 * radius + 1, p.shape[axis]), axis)
        a = (hi - np.take(p, range(0, p.shape[axis] - 2 * radius - 1), axis)) / (2 * radius + 1)
    return a


def dilate(mask: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def block_down(a: np.ndarray, d: int) -> np.ndarray:
    h, w = max(2, a.shape[0] // d), max(2, a.shape[1] // d)
    part = a[: h * d, : w * d]
    ys, xs = np.minimum(np.arange(part.shape[0]) // d, h - 1), np.minimum(np.arange(part.shape[1]) // d, w - 1)
    total, n = np.zeros((h, w)), np.zeros((h, w))
    np.add.at(total, (ys[:, None], xs[None, :]), part)
    np.add.at(n, (ys[:, None], xs[None, :]), 1)
    return np.divide(total, n, out=np.zeros_like(total), where=n > 0)


def multiscale_model(a: np.ndarray, scale: float, smoothest: float) -> np.ndarray:
    """The smooth background of one channel: blur, reject what stands out, fill, again; then block-replicated."""
    work = block_down(a, FACTOR)
    r = max(1, int(scale / 100 * max(work.shape)))
    thrice = lambda z, q: box_blur(box_blur(box_blur(z, q), q), q)
    for _ in range(ITERATIONS):
        bg = thrice(work, r)
        left = work - bg
        flat = np.sort(left, axis=None)
        mid = flat[len(flat) // 2]
        sigma = MADN * np.sort(np.abs(flat - mid))[len(flat) // 2] + 1e-6
        mask = dilate(left > REJECT * sigma, GROW)
        work = np.where(mask, bg, work)
    bg = thrice(work, r)
    if smoothest > 0:
        bg = thrice(bg, max(1, int(r * 0.5 * smoothest)))
    ys, xs = np.minimum(np.arange(a.shape[0]) // FACTOR, bg.shape[0] - 1), np.minimum(np.arange(a.shape[1]) // FACTOR, bg.shape[1] - 1)
    return bg[ys[:, None], xs[None, :]]


def flatten_multiscale(planes: DataFrame, keys: list[str], scale: float = 20.0, smoothest: float = 0.5) -> DataFrame:
    """planes(keys, width, height, pixels array<double>) with the background taken off.

    One plane is one row: frames and channels run in parallel and none meets another.
    Images under 8 pixels a side pass as they are.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for w, h, v in zip(pdf["width"], pdf["height"], pdf["pixels"]):
                a = np.nan_to_num(np.asarray(v, float), nan=0.0, posinf=0.0, neginf=0.0).reshape(int(h), int(w))
                if w < 8 or h < 8:
                    out.append(list(map(float, v)))
                    continue
                m = multiscale_model(a, scale, smoothest)
                out.append(np.clip(a - m + m.min(), 0, 1).ravel().tolist())
            yield pdf[keys].assign(width=pdf["width"], height=pdf["height"], pixels=out)

    return planes.select(*keys, "width", "height", "pixels").mapInPandas(run, planes.select(*keys, "width", "height", "pixels").schema)
