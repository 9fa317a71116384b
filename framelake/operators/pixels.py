"""Pixel operators over long frames (keys, y, x, v): binning, calibration, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.stats import averaged_median, clamp, finite_or_zero, median_and_mad, strided, upper_median

#: The smallest flat, the luminance weights, the spread factor of a MAD.
MIN_FLAT = 1.0 / 65535
LUMA = (0.2126, 0.7152, 0.0722)
MADN = 1.4826


def flip(pixels: DataFrame, height: Column | int) -> DataFrame:
    """Bottom-up rows as top-down rows."""
    return pixels.withColumn("y", (F.lit(height) if isinstance(height, int) else height) - 1 - F.col("y"))


def crop(pixels: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """The inclusive rectangle, moved to the origin."""
    inside = pixels.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def half_res(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each 2x2 block of the raw mosaic; odd edges are left out by the caller's size."""
    return pixels.groupBy(*keys, F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.avg("v").alias("v"))


def downsample(pixels: DataFrame, keys: list[str], width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Area average into bins min(new - 1, i new div old)."""
    y = F.least(F.lit(new_height - 1), F.expr(f"y * {new_height} div {height}"))
    x = F.least(F.lit(new_width - 1), F.expr(f"x * {new_width} div {width}"))
    return pixels.groupBy(*keys, y.cast("long").alias("y"), x.cast("long").alias("x")).agg(F.avg("v").alias("v"))


def block_average(pixels: DataFrame, keys: list[str], width: int, height: int, d: int) -> DataFrame:
    """Blocks of d x d, at least 2 a side; pixels beyond the last whole block are dropped."""
    w, h = max(2, width // d), max(2, height // d)
    blocks = pixels.withColumns({"y": F.expr(f"y div {d}"), "x": F.expr(f"x div {d}")}).where((F.col("y") < h) & (F.col("x") < w))
    return blocks.groupBy(*keys, "y", "x").agg(F.avg("v").alias("v"))


def tile_of(c: str, size: int | str, tiles: int) -> Column:
    """The tile whose edges t size div tiles hold the position; size may name a column."""
    return F.expr(f"cast((({c} + 1) * {tiles} - 1) div {size} as bigint)")


def tile_medians(pixels: DataFrame, keys: list[str], width: int, height: int, tiles: int) -> DataFrame:
    """Upper median of each tile, non-finite values as 0."""
    p = pixels.withColumns({"ty": tile_of("y", height, tiles), "tx": tile_of("x", width, tiles), "v": finite_or_zero(F.col("v"))})
    return p.groupBy(*keys, "ty", "tx").agg(upper_median("v").alias("median"), F.count("*").alias("n"))


def sky_grid(pixels: DataFrame, keys: list[str], cell: int = 32, least: float = 1e-6) -> DataFrame:
    """Upper median and MADN (at least 1e-6) of each cell."""
    p = pixels.withColumns({"cy": F.expr(f"y div {cell}"), "cx": F.expr(f"x div {cell}")})
    grid = median_and_mad(p, [*keys, "cy", "cx"], "v")
    return grid.withColumn("sigma", F.greatest(F.lit(MADN) * F.col("mad"), F.lit(least))).drop("mad")


def frame_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """mean, averaged median and population standard deviation."""
    return pixels.groupBy(*keys).agg(F.avg("v").alias("mean"), averaged_median("v").alias("median"), F.stddev_pop("v").alias("stddev"))


def extent(pixels: DataFrame) -> tuple[int, int]:
    """(width, height) of the frame that pixels hold."""
    r = pixels.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    return (0, 0) if r["x"] is None else (r["x"] + 1, r["y"] + 1)


def calibrate(pixels: DataFrame, dark: DataFrame | None, flat: DataFrame | None, on: list[str], broadcast_rows: int = 2_000_000, size: tuple[str, str] | None = None) -> DataFrame:
    """v less dark, over flat, at most 1; negatives stay and non-finite becomes 0.

    size names the columns with a light's width and height: a master of another size is
    skipped whole for that light, and a light without any passes as it is. Masters are one frame;
    they are broadcast only below broadcast_rows pixels and joined by shuffle above.
    """
    out = pixels
    for master, name in ((dark, "d"), (flat, "f")):
        if master is not None:
            small = master.limit(broadcast_rows + 1).count() <= broadcast_rows
            out = out.join(F.broadcast(master) if small else master, on, "left")
    fits = {}
    for master, name in ((dark, "d"), (flat, "f")):
        if master is not None and size:
            w, h = extent(master)
            fits[name] = (F.col(size[0]) == w) & (F.col(size[1]) == h)
            out = out.withColumn(name, F.when(fits[name], F.col(name)))
    v = F.col("v")
    if dark is not None:
        v = v - F.coalesce(F.col("d"), F.lit(0.0))
    if flat is not None:
        v = v / F.greatest(F.coalesce(F.col("f"), F.lit(1.0)), F.lit(MIN_FLAT))
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    done = F.when(finite, F.least(v, F.lit(1.0))).otherwise(0.0)
    if fits:
        done = F.when(~F.array_contains(F.array(*fits.values()), True), F.col("v")).otherwise(done)
    return out.withColumn("v", done).select(*pixels.columns)


def same_size(pixels: DataFrame, frames: DataFrame, frame: str = "frame", order: str = "frame") -> DataFrame:
    """Pixels of the frames that have the size of the first valid one. frames: frame, width, height, channels, null where unreadable."""
    valid = frames.where(F.col("width").isNotNull())
    shape = F.struct("width", "height", "channels")
    first = valid.agg(F.min_by(shape, order).alias("_first"))  # one row
    kept = valid.crossJoin(F.broadcast(first)).where(shape == F.col("_first")).select(frame)
    return pixels.join(kept, frame, "left_semi")


def master_mean(pixels: DataFrame, on: list[str]) -> DataFrame:
    return pixels.groupBy(*on).agg(F.avg("v").alias("v"))


def master_flat(pixels: DataFrame, bias: DataFrame | None, on: list[str]) -> DataFrame:
    """Mean of the bias-free frames, floored, over its own averaged median; a bias of another size is skipped."""
    p = pixels
    if bias is not None and extent(bias) == extent(pixels):
        p = p.join(bias.withColumnRenamed("v", "_bias"), on, "left").withColumn("v", F.col("v") - F.coalesce(F.col("_bias"), F.lit(0.0)))
    mean = p.groupBy(*on).agg(F.greatest(F.avg("v"), F.lit(MIN_FLAT)).alias("v"))
    middle = mean.agg(averaged_median("v").alias("_middle"))  # one row
    return mean.crossJoin(F.broadcast(middle)).select(*on, (F.col("v") / F.col("_middle")).alias("v"))


def mtf(x: Column, m: Column) -> Column:
    """Midtone transfer: 0 below 0, 1 above 1."""
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.try_divide((m - 1) * x, (2 * m - 1) * x - m))


def auto_stretch(pixels: DataFrame, image: list[str], target: float = 0.25, shadows: float = 2.8, black: float = 0.0, strength: float = 0.0, size: tuple[int, int] | None = None) -> DataFrame:
    """Stretch of each image, linked over channels by its mean-of-channels sample.

    black (0 to 0.2) is clipped off the linear data first; strength (-1 to 1, 0 does nothing) moves the
    midtone. With size, the images' (width, height), statistics take a regular sample of at most 262,144
    positions; without it they take all.
    """
    black, factor = min(max(black, 0.0), 0.2), 2.0 ** -min(max(strength, -1.0), 1.0)
    if black:
        pixels = pixels.withColumn("v", F.greatest(F.lit(0.0), (F.col("v") - black) / (1 - black)))
    sample = strided(pixels, F.col("y") * size[0] + F.col("x"), size[0] * size[1]) if size else pixels
    linked = sample.groupBy(*image, "y", "x").agg(F.avg("v").alias("v"))
    s = median_and_mad(linked, image, "v")
    sigma = F.lit(MADN) * F.col("mad")
    spread = F.when(sigma > 1e-10, sigma).otherwise(F.greatest(F.col("median"), F.lit(1e-10)))
    s = s.withColumn("shadow", clamp(F.col("median") - F.lit(shadows) * spread))
    room = F.greatest(1 - F.col("shadow"), F.lit(1e-9))
    mid = mtf(clamp((F.col("median") - F.col("shadow")) / room, 1e-9), F.lit(target))
    if factor != 1.0:
        mid = clamp(mid * factor, 1e-4, 1 - 1e-4)
    s = s.withColumn("midtone", mid).select(*image, "shadow", "midtone")
    out = mtf(clamp((F.col("v") - F.col("shadow")) / room), F.col("midtone"))
    return pixels.join(s, image).withColumn("v", out).select(*pixels.columns)


def saturation(r: Column, g: Column, b: Column, factor: float) -> tuple[Column, Column, Column]:
    """Channels about their luminance; factor in [0, 2], 1 leaves them."""
    factor = min(max(factor, 0.0), 2.0)
    luma = LUMA[0] * r + LUMA[1] * g + LUMA[2] * b
    return tuple(clamp(luma + (c - luma) * factor) for c in (r, g, b))


def neutralize_mul(pixels: DataFrame, image: list[str]) -> DataFrame:
    """Red and blue scaled to green's median; medians of at most 1e-9 are left alone."""
    med = pixels.groupBy(*image, "c").agg(averaged_median("v").alias("med"))
    green = F.max(F.when(F.col("c") == 1, F.col("med"))).over(Window.partitionBy(*image))
    gain = F.when((F.col("c") == 1) | (F.col("med") <= 1e-9) | (green <= 1e-9), 1.0).otherwise(green / F.col("med"))
    return pixels.join(med.withColumn("gain", gain).drop("med"), [*image, "c"]).withColumn("v", F.when(F.col("gain") == 1.0, F.col("v")).otherwise(clamp(F.col("v") * F.col("gain")))).drop("gain")


def neutralize_add(pixels: DataFrame, image: list[str], width: int | str, height: int | str, tiles: int = 48, share: float = 0.2) -> DataFrame:
    """Each channel less what its background (nearest-rank share of tile medians) exceeds the least one by."""
    p = pixels.withColumns({"ty": tile_of("y", height, tiles), "tx": tile_of("x", width, tiles)})
    tile = p.groupBy(*image, "c", "ty", "tx").agg(averaged_median("v").alias("med"))
    ranked = tile.groupBy(*image, "c").agg(F.array_sort(F.collect_list("med")).alias("_m"))
    bg = ranked.select(*image, "c", F.element_at("_m", F.round(F.lit(share) * (F.size("_m") - 1)).cast("int") + 1).alias("bg"))
    bg = bg.withColumn("off", F.col("bg") - F.min("bg").over(Window.partitionBy(*image))).drop("bg")
    return pixels.join(bg, [*image, "c"]).withColumn("v", clamp(F.col("v") - F.col("off"))).drop("off")


def opponent(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return (r + 2 * g + b) / 4, r - g, b - g


def from_opponent(y: Column, c1: Column, c2: Column) -> tuple[Column, Column, Column]:
    g = y - (c1 + c2) / 4
    return c1 + g, g, c2 + g


def quantize8(v: Column) -> Column:
    return F.floor(clamp(v) * 255).cast("int")


def to_planes(pixels: DataFrame, image: list[str], width: int, height: int) -> DataFrame:
    """(image, width, height, pixels): one row an image, a channel of values in reading order in each of its arrays.

    An image is one row from here on, as flattening and denoising look at whole images.
    """
    channel = pixels.groupBy(*image, "c").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("_p"))
    whole = channel.groupBy(*image).agg(F.array_sort(F.collect_list(F.struct("c", F.transform("_p", lambda p: p["v"]).alias("v")))).alias("_c"))
    return whole.select(*image, F.lit(width).alias("width"), F.lit(height).alias("height"), F.transform("_c", lambda c: c["v"]).alias("pixels"))


def from_planes(planes: DataFrame, image: list[str]) -> DataFrame:
    """The long view (image, c, y, x, v) of to_planes."""
    p = planes.select(*image, "width", F.posexplode("pixels").alias("c", "_v")).select(*image, "c", "width", F.posexplode("_v").alias("_i", "v"))
    return p.select(*image, "c", F.floor(F.col("_i") / F.col("width")).alias("y"), (F.col("_i") % F.col("width")).cast("long").alias("x"), "v")


def display(
    pixels: DataFrame, image: list[str], width: int, height: int, linear: bool = True, flattened: bool = False, factor: float = 1.0, tiles: int = 48,
    flatten: tuple[float, float] | None = None, neutralize: bool = True, black: float = 0.0, strength: float = 0.0, noise: float = 0.0, pack: bool = False,
) -> DataFrame:
    """The display order for three channels: flatten, neutralize, stretch linear data, denoise, saturate, pack to 8 bits.

    flatten is (scale, smoothest), or None. Flattened images, here or before, are neutralized
    by gain only, others by offset and then by gain. The stretch takes its statistics from a
    sample of at most 262,144 positions. Turning north up is a matter of the canvas (sky.north_up).
    """
    from framelake.operators import background, filters

    p = pixels
    if flatten:
        planes = to_planes(p, image, width, height).select(*image, "width", "height", F.posexplode("pixels").alias("c", "pixels"))
        flat = background.flatten_multiscale(planes, [*image, "c"], *flatten)
        p = from_planes(flat.select(*image, "c", "width", F.array("pixels").alias("pixels")).withColumnRenamed("c", "_c"), [*image, "_c"]).drop("c").withColumnRenamed("_c", "c")
    if neutralize:
        p = neutralize_mul(p if flattened or flatten else neutralize_add(p, image, width, height, tiles), image)
    if linear:
        p = auto_stretch(p, image, black=black, strength=strength, size=(width, height))
    if noise > 0:
        p = from_planes(filters.denoise(to_planes(p, image, width, height).withColumn("linear", F.lit(False)), image, noise), image)
    wide = p.groupBy(*image, "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"c{k}") for k in range(3)])
    mixed = saturation(F.col("c0"), F.col("c1"), F.col("c2"), factor)
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), v.alias("v")) for k, v in enumerate(mixed)])).alias("s")
    out = wide.select(*image, "y", "x", both).select(*image, "s.c", "y", "x", "s.v")
    return out.withColumn("v", quantize8(F.col("v"))) if pack else out


def dilate(mask: DataFrame, keys: list[str], width: int, height: int, times: int = 1) -> DataFrame:
    """(keys, y, x) of set pixels grown by their four neighbours, times over."""
    steps = [(dy, dx) for dy in range(-times, times + 1) for dx in range(-times, times + 1) if abs(dy) + abs(dx) <= times]
    near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("s")
    grown = mask.select(*keys, near).select(*keys, "s.y", "s.x")
    return grown.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()
