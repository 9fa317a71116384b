"""Raster work on planes: one row an image, pixels row by row in an array; no operator here shuffles.

A task holds a few images at once: for images of many megapixels set
spark.sql.execution.arrow.maxRecordsPerBatch to a small number. Keys and other columns of
a row pass through. Null pixels make null results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators import sky
from framelake.operators.filters import ALONG_ROW, DIAGONAL, GREEN, MOSAICS

_CROSS, _FULL = (0, 1, 0, 1, 4, 1, 0, 1, 0), (1, 2, 1, 2, 4, 2, 1, 2, 1)


def _each(planes: DataFrame, made: dict[str, str], work: Callable[[np.ndarray, pd.Series], tuple]) -> DataFrame:
    """planes without pixels, and the columns that work makes of each row's image."""
    kept = [f for f in planes.schema.fields if f.name != "pixels"]
    schema = T.StructType([*kept, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in made.items())).fields])

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                if row.pixels is None:
                    rows.append((None,) * len(made))
                else:
                    rows.append(work(np.asarray(row.pixels, float).reshape(int(row.height), int(row.width)), row))
            out = pdf.drop(columns="pixels")
            for name, values in zip(made, zip(*rows) if rows else [()] * len(made)):
                out[name] = list(values)
            yield out

    return planes.mapInPandas(run, schema)


def _conv(a: np.ndarray, mask: tuple[float, ...]) -> np.ndarray:
    """The correlation of a with a square mask; what lies outside counts 0."""
    side = int(len(mask) ** 0.5)
    r = side // 2
    wide = np.pad(a, r)
    out = np.zeros_like(a)
    for i, w in enumerate(mask):
        if w:
            dy, dx = divmod(i, side)
            out += w * wide[dy : dy + a.shape[0], dx : dx + a.shape[1]]
    return out


def _channels(pattern: str, shape: tuple[int, int]) -> np.ndarray:
    return np.tile(np.array(MOSAICS[pattern]).reshape(2, 2), (shape[0] // 2 + 1, shape[1] // 2 + 1))[: shape[0], : shape[1]]


def _bilinear(a: np.ndarray, colours: np.ndarray) -> list[np.ndarray]:
    out = []
    for c, mask in enumerate((_FULL, _CROSS, _FULL)):
        on = (colours == c).astype(float)
        total = _conv(on, mask)
        out.append(np.divide(_conv(a * on, mask), total, out=np.zeros_like(a), where=total > 0))
    return out


def _malvar(a: np.ndarray, pattern: str, min_rows: int) -> list[np.ndarray]:
    colours = _channels(pattern, a.shape)
    rgb = _bilinear(a, colours)
    h, w = a.shape
    if w < 5 or h < 5 or h < min_rows:
        return rgb
    turned = tuple(np.array(ALONG_ROW).reshape(5, 5).T.ravel().tolist())
    green, row, column, diagonal = _conv(a, GREEN) / 8, _conv(a, ALONG_ROW) / 16, _conv(a, turned) / 16, _conv(a, DIAGONAL) / 16
    beside = _channels(pattern, (h, w + 1))[:, 1:]
    fine = [np.where(colours == c, a, np.where(colours == 1, np.where(beside == c, row, column), diagonal)) for c in (0, 1, 2)]
    fine[1] = np.where(colours == 1, a, green)
    for plane, better in zip(rgb, fine):
        plane[2:-2, 2:-2] = better[2:-2, 2:-2]
    return rgb


_RGB = {c: "array<double>" for c in "rgb"}


def debayer_bilinear(planes: DataFrame, pattern: str) -> DataFrame:
    """planes(..., width, height, pixels) with r, g, b in place of pixels."""
    return _each(planes, _RGB, lambda a, _: tuple(p.ravel() for p in _bilinear(a, _channels(pattern, a.shape))))


def debayer_malvar(planes: DataFrame, pattern: str, min_rows: int = 64) -> DataFrame:
    """Linear 5 x 5 demosaic; a border of 2 and images that are too small are bilinear. Not clamped."""
    return _each(planes, _RGB, lambda a, _: tuple(p.ravel() for p in _malvar(a, pattern, min_rows)))


def warp_bilinear(planes: DataFrame) -> DataFrame:
    """planes(..., scale, rotation, tx, ty, width, height, pixels) warped: v, and the mask m, gathered through the inverse transform."""

    def work(a: np.ndarray, row) -> tuple:
        h, w = a.shape
        c, s = np.cos(row.rotation) / row.scale, np.sin(row.rotation) / row.scale
        y, x = np.mgrid[:h, :w].astype(float)
        sx, sy = c * (x - row.tx) + s * (y - row.ty), -s * (x - row.tx) + c * (y - row.ty)
        inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1)
        x0, y0 = np.where(inside, np.floor(sx), 0).astype(int), np.where(inside, np.floor(sy), 0).astype(int)
        x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), sx - x0, sy - y0
        v = (1 - fx) * (1 - fy) * a[y0, x0] + fx * (1 - fy) * a[y0, x1] + (1 - fx) * fy * a[y1, x0] + fx * fy * a[y1, x1]
        return np.where(inside, v, 0.0).ravel(), inside.astype(np.int32).ravel()

    return _each(planes, {"v": "array<double>", "m": "array<int>"}, work)


def long_view(planes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, y, x, values): one row a pixel."""
    at = planes.select(*keys, "width", F.posexplode(F.arrays_zip(*values)).alias("i", "p"))
    return at.select(*keys, F.expr("cast(i div width as bigint)").alias("y"), F.expr("cast(i % width as bigint)").alias("x"), *[F.col(f"p.{v}") for v in values])


def turned(a: np.ndarray, rotation: float, out_width: int, out_height: int, zoom: float) -> np.ndarray:
    """[channel, y, x] on another canvas, turned about its centre by rotation degrees: what the frame shows at R(-rotation) p / zoom comes to p.

    Values between pixels are bilinear with edges repeated; what lies off the frame is 0.
    """
    c, s = np.cos(np.radians(rotation)), np.sin(np.radians(rotation))
    h, w = a.shape[1:]
    py, px = np.mgrid[0:out_height, 0:out_width].astype(float)
    px, py = (px + 0.5 - out_width / 2) / zoom, (py + 0.5 - out_height / 2) / zoom
    x, y = c * px + s * py + w / 2 - 0.5, -s * px + c * py + h / 2 - 0.5
    inside = (x > -0.5 - 1e-9) & (x < w - 0.5 + 1e-9) & (y > -0.5 - 1e-9) & (y < h - 0.5 + 1e-9)
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    top, low = a[:, y0, x0] * (1 - fx) + a[:, y0, x1] * fx, a[:, y1, x0] * (1 - fx) + a[:, y1, x1] * fx
    return np.where(inside, top * (1 - fy) + low * fy, 0.0)


def turn_north_up(planes: DataFrame, keys: list[str], rotation: str, auto_zoom: bool = True) -> DataFrame:
    """(keys, width, height, pixels of 1 or 3 channels) with north up; frames without a rotation pass as they are."""
    canvas = sky.north_up(F.col(rotation), F.col("width"), F.col("height"), auto_zoom)
    out = T.StructType([*planes.select(*keys).schema.fields, T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("pixels", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        for pdf in batches:
            new = []
            for r in pdf.itertuples(index=False):
                if r.turn is None or r.turn != r.turn:
                    new.append((r.width, r.height, r.pixels))
                    continue
                a = np.array([np.asarray(p, float) for p in r.pixels]).reshape(len(r.pixels), int(r.height), int(r.width))
                b = turned(a, float(r.turn), int(r.out_width), int(r.out_height), float(r.zoom))
                new.append((int(r.out_width), int(r.out_height), b.reshape(len(b), -1).tolist()))
            yield pdf[keys].assign(**{c: pd.Series([n[k] for n in new], index=pdf.index, dtype=object if c == "pixels" else "int64") for k, c in enumerate(("width", "height", "pixels"))})

    wide = planes.select(*keys, F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "pixels", F.col(rotation).cast("double").alias("turn"), canvas.alias("_c"))
    return wide.select("*", "_c.*").drop("_c").mapInPandas(run, out)
