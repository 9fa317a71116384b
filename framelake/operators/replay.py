"""Replay: the quality gate, keyframes and the render plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.stats import upper_median_of

#: Fixed values of the gate: relative deviations that drop, and the least scale.
DARK, BRIGHT, LEAST_SCALE, WINDOW = -0.8, 0.5, 0.01, 5


def gate(medians: Column, window: int = WINDOW, bright: float = BRIGHT) -> Column:
    """Indices (from 0) that stay of an ordered series of medians.

    A fold over the inner frames whose state is the kept indices, the last kept values
    and the pending excursion with its sign. The first and last frame stay; a run of
    one sign longer than the window is taken whole; a bright one pending at the end too.
    """
    window = max(1, window)
    ints, doubles = "array<int>", "array<double>"
    first = F.element_at(medians, 1)
    start = F.struct(
        F.array(F.lit(0)).cast(ints).alias("kept"), F.array(first).cast(doubles).alias("recent"),
        F.array().cast(ints).alias("pending"), F.array().cast(doubles).alias("values"), F.lit(0).alias("sign"),
    )
    tail = lambda a: F.slice(a, F.greatest(F.lit(1), F.size(a) - window + 1), F.lit(window))

    def step(a: Column, p: Column) -> Column:
        v, i = p["v"], F.array(p["i"])
        base = upper_median_of(a["recent"])
        away = (v - base) / F.greatest(F.abs(base), F.lit(LEAST_SCALE))
        out = (away < DARK) | (away > bright)
        sign = F.when(away > 0, 1).otherwise(-1)
        same = a["sign"] == sign
        pending = F.when(same, F.concat(a["pending"], i)).otherwise(i)
        values = F.when(same, F.concat(a["values"], F.array(v))).otherwise(F.array(v))
        adopt = F.size(pending) > window
        none_i, none_v = F.array().cast(ints), F.array().cast(doubles)
        state = lambda k, r, pe, va, s: F.struct(k.alias("kept"), r.alias("recent"), pe.alias("pending"), va.alias("values"), s.alias("sign"))
        return (
            F.when(out & adopt, state(F.concat(a["kept"], pending), tail(F.concat(a["recent"], values)), none_i, none_v, F.lit(0)))
            .when(out, state(a["kept"], a["recent"], pending, values, sign))
            .otherwise(state(F.concat(a["kept"], i), tail(F.concat(a["recent"], F.array(v))), none_i, none_v, F.lit(0)))
        )

    n = F.size(medians)
    inner = F.filter(F.transform(medians, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: (p["i"] > 0) & (p["i"] < n - 1))
    end = lambda a: F.concat(a["kept"], F.when((a["sign"] > 0), a["pending"]).otherwise(F.array().cast(ints)), F.array(n - 1))
    return F.when(n <= 2, F.transform(medians, lambda v, i: i)).otherwise(F.aggregate(inner, start, step, end))


def quality_gate(snapshots: DataFrame, session: str, order: list[str], keep: list[str]) -> DataFrame:
    """The snapshots that stay. One session's medians are folded together (16 bytes a frame)."""
    o = F.struct(*order, "median", *[c for c in keep if c not in order])
    g = snapshots.groupBy(session).agg(F.array_sort(F.collect_list(o)).alias("s"))
    g = g.withColumn("i", F.explode(gate(F.transform("s", lambda x: x["median"]))))
    return g.select(session, F.element_at("s", F.col("i") + 1).alias("r")).select(session, *[F.col(f"r.{c}").alias(c) for c in keep])


def log_keyframes(count: Column, k: int) -> Column:
    """Log-spaced indices round(count^(j/(k-1)) - 1), with 0 and the last; all if count <= k."""
    k = max(2, k)
    every = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.least(F.greatest(F.round(F.pow(count.cast("double"), j / (k - 1)) - 1).cast("int"), F.lit(0)), count.cast("int") - 1))
    return F.when(count <= k, every).otherwise(F.array_sort(F.array_distinct(F.concat(at, F.array(F.lit(0), count.cast("int") - 1)))))


def dedupe(values: Column, least: float = 0.01) -> Column:
    """Indices of an ordered series kept: the first, those that differ from the last kept by least, the last."""
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(None).cast("double").alias("last"))
    n = F.size(values)

    def step(a: Column, p: Column) -> Column:
        take = a["last"].isNull() | (F.abs(p["v"] - a["last"]) >= least) | (p["i"] == n - 1)
        return F.when(take, F.struct(F.concat(a["kept"], F.array(p["i"])).alias("kept"), p["v"].alias("last"))).otherwise(a)

    return F.aggregate(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), start, step, lambda a: a["kept"])


def thumb_difference(thumbs: DataFrame, keys: list[str], order: str, at: list[str]) -> DataFrame:
    """Mean absolute difference of each thumbnail from the one before it. thumbs: keys, order, at, v."""
    from pyspark.sql import Window

    before = F.lag("v").over(Window.partitionBy(*keys, *at).orderBy(order))
    return thumbs.withColumn("_d", F.abs(F.col("v") - before)).where("_d is not null").groupBy(*keys, order).agg(F.avg("_d").alias("difference"))


def replay_plan(frames: DataFrame, keyframes: int, fade: float = 0.5, seconds: float = 45.0, fps: int = 30) -> DataFrame:
    """For each video frame f: keyframes i and j, the blend, and the one whose caption shows."""
    total = int(seconds * fps)
    segment = total / keyframes
    fade_frames = min(1.0, fade * fps / segment)
    pos = F.col("f") / segment
    i = F.least(F.floor(pos).cast("long"), F.lit(keyframes - 1))
    blend = F.greatest(F.lit(0.0), (pos - i - (1 - fade_frames)) / fade_frames)
    out = frames.withColumns({"i": i, "j": F.least(i + 1, F.lit(keyframes - 1)), "blend": F.least(blend, F.lit(1.0))})
    return out.withColumn("caption_of", F.when(F.col("blend") >= 0.5, F.col("j")).otherwise(F.col("i")))


def aspect_fit(w: Column, h: Column, box_w: float, box_h: float) -> tuple[Column, Column, Column, Column]:
    """x, y, width, height of the largest centred rectangle of that shape."""
    s = F.least(box_w / w, box_h / h)
    return (box_w - w * s) / 2, (box_h - h * s) / 2, w * s, h * s
