"""Synthetic frames: a fixed star field whose noise falls with the frame's number.

Each frame is made by the task that holds its number: the generator's state is taken
straight to the frame's first draw, so no frame waits for those before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from framelake.sources import fits

# The generator's seed, factor and step, and the field's make-up.
SEED, FACTOR, STEP = 0x5EED, 6364136223846793005, 1442695040888963407
WIDTH, HEIGHT, STARS = 800, 500, 120
FLOOR, NOISE = 0.02, 0.08
_MOD = 1 << 64


def state_after(draws: int) -> int:
    """The generator's state after so many draws, in closed form."""
    power = pow(FACTOR, draws, (FACTOR - 1) * _MOD)
    return (power * SEED + (power - 1) // (FACTOR - 1) * STEP) % _MOD


def draws(first: int, n: int) -> np.ndarray:
    """Draws first, first + 1, ... as float64."""
    powers = np.multiply.accumulate(np.full(n, FACTOR % _MOD, np.uint64))
    sums = np.add.accumulate(np.concatenate([np.ones(min(n, 1), np.uint64), powers[:-1]]))
    states = powers * np.uint64(state_after(first)) + sums * np.uint64(STEP)
    return (states >> np.uint64(33)) / float(2**32 - 1)


def frame(k: int, count: int, width: int = WIDTH, height: int = HEIGHT, stars: int = STARS) -> np.ndarray:
    """Pixels [y, x] of frame k of count (from 1), float32."""
    field = draws(0, 3 * stars).reshape(stars, 3)
    noise = draws(3 * stars + (k - 1) * width * height, width * height).reshape(height, width)
    out = np.maximum(0, FLOOR + (noise - 0.5) * 2 * (NOISE / np.sqrt(k))).astype(np.float32)
    away = np.arange(-2, 3)
    spread = (1 / (1 + away[:, None] ** 2 + away[None, :] ** 2)).astype(np.float32)
    for fx, fy, fb in field:
        x, y = int(fx * width), int(fy * height)
        light = np.float32(min(1, (0.3 + fb * 0.7) * (0.3 + 0.7 * k / count))) * spread
        x0, y0, x1, y1 = max(0, x - 2), max(0, y - 2), min(width, x + 3), min(height, y + 3)
        seen = light[y0 - y + 2 : y1 - y + 2, x0 - x + 2 : x1 - x + 2]
        out[y0:y1, x0:x1] = np.minimum(1, out[y0:y1, x0:x1] + seen)
    return out


def frames(spark: SparkSession, count: int = 40, width: int = WIDTH, height: int = HEIGHT, stars: int = STARS) -> DataFrame:
    """(k, content): count encoded files, one a row; a prefix of content is a file caught half written."""

    def run(batches):
        for pdf in batches:
            for k in pdf["id"].tolist():
                yield pd.DataFrame({"k": [k], "content": [fits.encode(frame(k, count, width, height, stars)[None])]})

    return spark.range(1, count + 1).mapInPandas(run, "k long, content binary")
