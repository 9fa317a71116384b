"""Stacking: admission, weights, ordered clipping, weighted means, coverage, levelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.stats import averaged_median, clamp

WEIGHT_RANGE, MIN_SIGMA = (0.25, 4.0), 1e-6
MIN_SEED_STARS, MIN_MATCH_STARS = 15, 3
RESEED_AFTER = 6
KAPPA = {"low": 3.5, "medium": 3.0, "high": 2.5}
WARM_UP = 8


def frame_weights(frames: DataFrame, session: str = "session", order: str = "frame") -> DataFrame:
    """weight of each frame from stars and sigma against its session's first frame."""
    w = Window.partitionBy(session).orderBy(order)
    stars0, sigma0 = F.first("stars").over(w), F.first("sigma").over(w)
    ratio = sigma0 / F.greatest(F.col("sigma"), F.lit(MIN_SIGMA))
    return frames.withColumn("weight", clamp(F.col("stars") / stars0 * ratio * ratio, *WEIGHT_RANGE))


def weighted_mean(pixels: DataFrame, keys: list[str], value: str = "v", mask: str = "m", weight: str | None = None) -> DataFrame:
    """Per key: the masked weighted mean (0 without weight) and the unweighted coverage, in one aggregate."""
    w = F.col(mask) * (F.col(weight) if weight else F.lit(1.0))
    total = F.sum(w)
    mean = F.when(total > 0, F.sum(w * F.col(value)) / total).otherwise(0.0)
    return pixels.groupBy(*keys).agg(mean.alias("mean"), F.sum(mask).alias("coverage"))


def winsorized(array: Column, kappa: float = KAPPA["medium"], warm_up: int = WARM_UP) -> Column:
    """(n, mean, m2, last) after the ordered clip over values in order.

    Past the warm-up a value is clamped to mean +- kappa sigma before it counts.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0.0).alias("last"), F.lit(0).cast("long").alias("clipped"))

    def step(a: Column, v: Column) -> Column:
        room = F.lit(kappa) * F.sqrt(a["m2"] / F.greatest(a["n"], F.lit(1)))
        c = F.when(a["n"] >= max(2, warm_up), clamp(v, a["mean"] - room, a["mean"] + room)).otherwise(v)
        n = a["n"] + 1
        mean = a["mean"] + (c - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (c - a["mean"]) * (c - mean)).alias("m2"), c.alias("last"), (a["clipped"] + F.when(c != v, 1).otherwise(0)).alias("clipped"))

    return F.aggregate(array, start, step)


def winsor_clip(pixels: DataFrame, keys: list[str], order: str, value: str = "v", mask: str = "m", kappa: float = KAPPA["medium"], warm_up: int = WARM_UP) -> DataFrame:
    """Per key the running state after all unmasked frames in order.

    A group is one pixel's series over a session: frames x 16 bytes.
    """
    series = pixels.where(F.col(mask) > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("s"))
    return series.select(*keys, winsorized(F.transform("s", lambda s: s["v"]), kappa, warm_up).alias("state")).select(*keys, "state.*")


def admission(frames: DataFrame, session: str = "session", order: str = "frame") -> DataFrame:
    """outcome of each frame: seed, stacked or rejected with a reason.

    The first frame with enough stars seeds; earlier ones lack stars and later ones
    must have the seed's size, its channels (where frames has them) and enough stars to match.
    """
    channels = F.col("channels") if "channels" in frames.columns else F.lit(1)
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seeds = F.when((F.col("stars") >= MIN_SEED_STARS) & (F.col("width") >= 2) & (F.col("height") >= 2), F.struct("width", "height", channels.alias("channels")))
    df = frames.withColumn("_seed", F.first(seeds, ignorenulls=True).over(w))
    outcome = (
        F.when((F.col("width") < 2) | (F.col("height") < 2), "too_small")
        .when(F.col("_seed").isNull(), F.when(F.col("stars") >= MIN_SEED_STARS, "seed").otherwise("few_seed_stars"))
        .when((F.col("width") != F.col("_seed.width")) | (F.col("height") != F.col("_seed.height")), "size_mismatch")
        .when(channels != F.col("_seed.channels"), "channel_mismatch")
        .when(F.col("stars") < MIN_MATCH_STARS, "few_stars")
        .otherwise("stacked")
    )
    return df.withColumn("outcome", outcome).drop("_seed")


def scale_factor(pairs: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Median of ref_flux / flux per key in [0.5, 2]; 1 with fewer than least valid ratios."""
    ratio = F.try_divide(F.col("ref_flux"), F.col("flux"))
    valid = F.when((ratio > 0) & ~F.isnan(ratio) & (ratio < float("inf")), ratio)
    return pairs.groupBy(*keys).agg(F.when(F.count(valid) < least, 1.0).otherwise(clamp(averaged_median(valid), 0.5, 2.0)).alias("scale"), F.count(valid).alias("n_ratios"))


def level(pixels: DataFrame, frame_keys: list[str]) -> DataFrame:
    """surf_ref + (v - surf_sub) s, at most 1; channels without a pair of surfaces pass.

    One channel without a pair sets s to 1 for its whole frame.
    """
    paired = F.col("surf_ref").isNotNull() & F.col("surf_sub").isNotNull()
    all_paired = F.min(paired).over(Window.partitionBy(*frame_keys))
    s = F.when(all_paired, F.col("scale")).otherwise(1.0)
    return pixels.withColumn("levelled", F.when(paired, F.least(F.col("surf_ref") + (F.col("v") - F.col("surf_sub")) * s, F.lit(1.0))).otherwise(F.col("v")))


def crop_rect(coverage: DataFrame, keys: list[str], share: float = 0.9, line_share: float = 0.5) -> DataFrame:
    """Inclusive x0, y0, x1, y1 of the first and last rows and columns that are covered enough."""
    peak = F.max("coverage").over(Window.partitionBy(*keys))
    ok = coverage.withColumn("ok", (F.col("coverage") >= share * peak).cast("int"))
    rows = ok.groupBy(*keys, "y").agg(F.sum("ok").alias("n"), F.count("*").alias("span")).where(F.col("n") >= line_share * F.col("span"))
    cols = ok.groupBy(*keys, "x").agg(F.sum("ok").alias("n"), F.count("*").alias("span")).where(F.col("n") >= line_share * F.col("span"))
    return rows.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1")).join(cols.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1")), keys)


def guarded_crop(rect: DataFrame, width: int, height: int, least: int = 6) -> DataFrame:
    """rect with cropped: whether it is a real crop that keeps at least six tenths of the frame; if not it becomes the full frame."""
    area = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    full = (F.col("x0") == 0) & (F.col("y0") == 0) & (F.col("x1") == width - 1) & (F.col("y1") == height - 1)
    out = rect.withColumn("cropped", ~full & (area >= width * height * least // 10))
    whole = {"x0": 0, "y0": 0, "x1": width - 1, "y1": height - 1}
    return out.withColumns({c: F.when(F.col("cropped"), F.col(c)).otherwise(F.lit(v)).cast("long") for c, v in whole.items()})


def master(pixels: DataFrame, keys: list[str], width: int, height: int, weight: str | None = None) -> DataFrame:
    """(keys, y, x, mean): the stack's weighted mean, cropped to its covered region unless that takes too much."""
    mean = weighted_mean(pixels, [*keys, "y", "x"], weight=weight)
    rect = guarded_crop(crop_rect(mean, keys), width, height)
    whole = {"x0": 0, "y0": 0, "x1": width - 1, "y1": height - 1}
    inside = mean.join(rect, keys, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in whole.items()})
    inside = inside.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return inside.select(*keys, (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "mean")


def master_image(pixels: DataFrame, keys: list[str], width: int, height: int, weight: str | None = None, neutralize: bool = True, tiles: int = 48) -> DataFrame:
    """(keys, c, y, x, width, height, mean) of the master: the weighted mean of each channel, cropped as one image, then
    with its backgrounds brought to one level by offset where there are three channels.

    Channels share the first one's coverage, as a frame covers all of them alike. Gains are
    left alone, so colour ratios stay as measured.
    """
    from framelake.operators import pixels as p

    mean = weighted_mean(pixels, [*keys, "c", "y", "x"], weight=weight)
    rect = guarded_crop(crop_rect(mean.where("c = 0"), keys), width, height)
    whole = {"x0": 0, "y0": 0, "x1": width - 1, "y1": height - 1}
    inside = mean.join(rect, keys, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in whole.items()})
    inside = inside.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    size = [(F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height")]
    out = inside.select(*keys, "c", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *size, F.col("mean").alias("v"))
    if neutralize:
        three = F.max("c").over(Window.partitionBy(*keys)) == 2
        marked = out.withColumn("_three", three)
        rgb = p.neutralize_add(marked.where("_three").drop("_three"), keys, "width", "height", tiles)
        out = marked.where("NOT _three").drop("_three").unionByName(rgb)
    return out.withColumnRenamed("v", "mean")


def master_files(master: DataFrame, keys: list[str], frames: DataFrame, sub_seconds: str) -> DataFrame:
    """(keys, content): one encoded file for each master_image, with its frames and their exposure on its cards.

    frames: keys, n (frames in the stack) and seconds of each.
    """
    from framelake.sources import fits

    rows = master.groupBy(*keys, "c", "y").agg(F.array_sort(F.collect_list(F.struct("x", "mean"))).alias("_r"))
    rows = rows.select(*keys, "c", "y", F.transform("_r", lambda r: r["mean"].cast("float")).alias("row"))
    told = frames.select(*keys, "n", (F.col("n") * F.col(sub_seconds)).alias("exposure"))
    return fits.write_frames(rows.join(told, keys), keys, "n", "exposure")


def reseed_epochs(frames: DataFrame, session: str, order: list[str], failed: Column, after: int = RESEED_AFTER) -> DataFrame:
    """run: consecutive failures so far; epoch: reseeds before this frame. A run ends at a reseed."""
    w = Window.partitionBy(session).orderBy(*order)
    df = frames.withColumn("_f", failed.cast("int"))
    df = df.withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    run = F.sum("_f").over(Window.partitionBy(session, "_island").orderBy(*order))
    df = df.withColumn("_run", run).withColumn("reseed", (F.col("_f") == 1) & (F.col("_run") % after == 0))
    df = df.withColumn("run", F.when(F.col("_f") == 1, (F.col("_run") - 1) % after + 1).otherwise(0))
    epoch = F.coalesce(F.sum(F.col("reseed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("epoch", epoch).drop("_f", "_island", "_run")


def manual_reseeds(frames: DataFrame, session: str, order: list[str], asked: Column, native: Column, importing: Column, claimed: Column) -> DataFrame:
    """answer: done, or why an asked reseed is refused; epoch: reseeds done up to the frame. Session totals carry on."""
    answer = F.when(~asked, None).when(~native, "not_native").when(importing, "importing").when(claimed, "finalizing").otherwise("done")
    df = frames.withColumn("answer", answer)
    done = F.coalesce((F.col("answer") == "done").cast("int"), F.lit(0))
    return df.withColumn("epoch", F.sum(done).over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
