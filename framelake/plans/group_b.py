"""Pixel queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions.stats import clamp
from framelake.operators import pixels as p
from framelake.plans.registry import MASTERS, PX, RGB, query
from framelake.sources import surrogates as s


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("""SELECT l_suppkey AS frame, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_pop(l_extendedprice), 4) AS stddev
FROM lineitem GROUP BY l_suppkey""")
def frame_stats(spark, d):
    out = p.frame_stats(s.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), F.col("l_extendedprice").alias("v")), ["frame"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "median", "stddev")})


@query(f"WITH {PX} SELECT frame, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM px GROUP BY frame, y // 2, x // 2")
def half_res(spark, d):
    return _r(p.half_res(s.px(spark, d), ["frame"]), "v")


@query(f"WITH {PX} SELECT frame, least(2, y * 3 // 8) AS y, least(4, x * 5 // 8) AS x, round(avg(v), 6) AS v FROM px GROUP BY ALL")
def downsample(spark, d):
    return _r(p.downsample(s.px(spark, d), ["frame"], 8, 8, 5, 3), "v")


@query(f"WITH {PX} SELECT frame, y // 3 AS y, x // 3 AS x, round(avg(v), 6) AS v FROM px WHERE y // 3 < 2 AND x // 3 < 2 GROUP BY ALL")
def block_average(spark, d):
    return _r(p.block_average(s.px(spark, d), ["frame"], 8, 8, 3), "v")


@query(f"""WITH {PX}, e AS (SELECT t, t * 8 // 3 AS a, (t + 1) * 8 // 3 AS b FROM range(3) r(t))
SELECT frame, ey.t AS ty, ex.t AS tx, round(list_sort(list(v))[count(*) // 2 + 1], 6) AS median, count(*) AS n
FROM px JOIN e ey ON y >= ey.a AND y < ey.b JOIN e ex ON x >= ex.a AND x < ex.b GROUP BY ALL""")
def tile_medians(spark, d):
    return _r(p.tile_medians(s.px(spark, d), ["frame"], 8, 8, 3), "median")


@query(f"""WITH {PX}, c AS (SELECT frame, y // 4 AS cy, x // 4 AS cx, v FROM px), md AS (SELECT frame, cy, cx, list_sort(list(v))[count(*) // 2 + 1] AS median FROM c GROUP BY ALL)
SELECT frame, cy, cx, round(median, 6) AS median, round(greatest(1.4826 * list_sort(list(abs(v - median)))[count(*) // 2 + 1], 1e-6), 6) AS sigma
FROM c JOIN md USING (frame, cy, cx) GROUP BY frame, cy, cx, median""")
def sky_grid(spark, d):
    return _r(p.sky_grid(s.px(spark, d), ["frame"], cell=4), "median", "sigma")


@query(f"""WITH {PX}, c AS (SELECT frame, y // 4 AS cy, x // 4 AS cx, v FROM px), md AS (SELECT frame, cy, cx, list_sort(list(v))[count(*) // 2 + 1] AS median FROM c GROUP BY ALL),
g AS (SELECT frame, cy, cx, greatest(1.4826 * list_sort(list(abs(v - median)))[count(*) // 2 + 1], 1e-6) AS sigma FROM c JOIN md USING (frame, cy, cx) GROUP BY frame, cy, cx, median)
SELECT frame, round(list_sort(list(sigma))[count(*) // 2 + 1], 6) AS sigma FROM g GROUP BY frame""")
def frame_sigma(spark, d):
    from framelake.functions.stats import upper_median

    return _r(p.sky_grid(s.px(spark, d), ["frame"], cell=4).groupBy("frame").agg(upper_median("sigma").alias("sigma")), "sigma")


@query(f"""WITH {MASTERS} SELECT frame, px.y, px.x, round(least((v - d) / greatest(f, 1.0 / 65535), 1.0), 6) AS v
FROM px JOIN dark USING (y, x) JOIN flat USING (y, x) WHERE session > 1""")
def calibrate(spark, d):
    lights = s.px(spark, d).where("session > 1").select("frame", "y", "x", "v")
    return _r(p.calibrate(lights, s.dark(spark, d), s.flat(spark, d), ["y", "x"]), "v")


@query(f"WITH {PX} SELECT y, x, round(avg(v), 6) AS v FROM px WHERE session = 0 GROUP BY y, x")
def master_dark(spark, d):
    return _r(p.master_mean(s.px(spark, d).where("session = 0"), ["y", "x"]), "v")


@query(f"""WITH {MASTERS}, g AS (SELECT px.y, px.x, greatest(avg(v - 0.1 * d), 1.0 / 65535) AS v FROM px JOIN dark USING (y, x) WHERE session = 1 GROUP BY px.y, px.x)
SELECT y, x, round(v / (SELECT median(v) FROM g), 6) AS v FROM g""")
def master_flat(spark, d):
    bias = s.dark(spark, d).select("y", "x", (F.lit(0.1) * F.col("d")).alias("v"))
    return _r(p.master_flat(s.px(spark, d).where("session = 1").select("y", "x", "v"), bias, ["y", "x"]), "v")


_MTF = "CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 ELSE (({m}) - 1) * {x} / ((2 * ({m}) - 1) * {x} - ({m})) END"


@query(f"""WITH {RGB}, l AS (SELECT image, y, x, avg(v) AS v FROM rgb GROUP BY ALL), md AS (SELECT image, list_sort(list(v))[count(*) // 2 + 1] AS med FROM l GROUP BY image),
ma AS (SELECT image, med, list_sort(list(abs(v - med)))[count(*) // 2 + 1] AS mad FROM l JOIN md USING (image) GROUP BY image, med),
sh AS (SELECT image, med, least(greatest(med - 2.8 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(med, 1e-10) END, 0), 1) AS shadow FROM ma),
mi AS (SELECT image, shadow, {_MTF.format(x="((med - shadow) / greatest(1 - shadow, 1e-10))", m="0.25::DOUBLE")} AS midtone FROM sh)
SELECT image, c, y, x, round({_MTF.format(x="least(greatest((v - shadow) / greatest(1 - shadow, 1e-10), 0), 1)", m="midtone")}, 6) AS v FROM rgb JOIN mi USING (image)""")
def mtf_stretch(spark, d):
    return _r(p.auto_stretch(s.rgb(spark, d), ["image"]), "v")


@query(f"""WITH {RGB}, w AS (SELECT image, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM rgb GROUP BY ALL),
l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS luma FROM w)
SELECT image, y, x, round(least(greatest(luma + (r - luma) * 1.4, 0), 1), 6) AS r, round(least(greatest(luma + (g - luma) * 1.4, 0), 1), 6) AS g, round(least(greatest(luma + (b - luma) * 1.4, 0), 1), 6) AS b FROM l""")
def saturation(spark, d):
    wide = s.rgb(spark, d).groupBy("image", "y", "x").pivot("c", [0, 1, 2]).agg(F.max("v"))
    r, g, b = p.saturation(F.col("0"), F.col("1"), F.col("2"), 1.4)
    return wide.select("image", "y", "x", F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


@query(f"""WITH {RGB}, md AS (SELECT image, c, median(v) AS med FROM rgb GROUP BY ALL), g AS (SELECT image, med AS green FROM md WHERE c = 1)
SELECT image, c, y, x, round(CASE WHEN c = 1 OR med <= 1e-9 OR green <= 1e-9 THEN v ELSE least(greatest(v * (green / med), 0), 1) END, 6) AS v FROM rgb JOIN md USING (image, c) JOIN g USING (image)""")
def neutralize_mul(spark, d):
    return _r(p.neutralize_mul(s.rgb(spark, d), ["image"]), "v")


@query(f"""WITH {RGB}, e AS (SELECT t, t * 8 // 4 AS a, (t + 1) * 8 // 4 AS b FROM range(4) r(t)),
t AS (SELECT image, c, ey.t AS ty, ex.t AS tx, median(v) AS med FROM rgb JOIN e ey ON y >= ey.a AND y < ey.b JOIN e ex ON x >= ex.a AND x < ex.b GROUP BY ALL),
b AS (SELECT image, c, list_sort(list(med))[round(0.2 * (count(*) - 1))::INT + 1] AS bg FROM t GROUP BY ALL)
SELECT image, c, y, x, round(least(greatest(v - (bg - mn), 0), 1), 6) AS v FROM rgb JOIN (SELECT *, min(bg) OVER (PARTITION BY image) AS mn FROM b) USING (image, c)""")
def neutralize_add(spark, d):
    return _r(p.neutralize_add(s.rgb(spark, d), ["image"], 8, 8, tiles=4), "v")


@query(f"""WITH {RGB}, w AS (SELECT image, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM rgb GROUP BY ALL)
SELECT image, y, x, round((r + 2 * g + b) / 4, 6) AS luma, round(r - g, 6) AS c1, round(b - g, 6) AS c2 FROM w""")
def opponent(spark, d):
    wide = s.rgb(spark, d).groupBy("image", "y", "x").pivot("c", [0, 1, 2]).agg(F.max("v"))
    a, b, c = p.opponent(F.col("0"), F.col("1"), F.col("2"))
    return wide.select("image", "y", "x", F.round(a, 6).alias("luma"), F.round(b, 6).alias("c1"), F.round(c, 6).alias("c2"))


@query(f"WITH {PX} SELECT frame, y, x, floor(least(greatest(v, 0), 1) * 255)::INT AS q FROM px")
def quantize8(spark, d):
    return s.px(spark, d).select("frame", "y", "x", p.quantize8(F.col("v")).alias("q"))


@query(f"WITH {PX} SELECT frame, y - 2 AS y, x - 1 AS x, round(v, 6) AS v FROM px WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 7")
def crop(spark, d):
    out = p.crop(s.px(spark, d), F.lit(1), F.lit(2), F.lit(5), F.lit(7))
    return out.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("v", 6).alias("v"))


@query(f"WITH {PX} SELECT frame, CASE WHEN frame % 2 = 0 THEN 7 - y ELSE y END AS y, x, round(v, 6) AS v FROM px")
def orientation(spark, d):
    up = F.col("frame") % 2 == 0
    px = s.px(spark, d)
    both = p.flip(px.where(up), 8).unionByName(px.where(~up))
    return both.select("frame", F.col("y").cast("long").alias("y"), "x", F.round("v", 6).alias("v"))


@query(f"""WITH {PX}, z AS (SELECT *, 0.1::DOUBLE + 0.02 * (x / 8.0::DOUBLE * 2 - 1) + 0.03 * (y / 8.0::DOUBLE * 2 - 1) AS surface FROM px)
SELECT frame, y, x, round(least(greatest(v - surface + min(surface) OVER (PARTITION BY frame), 0), 1), 6) AS v FROM z""")
def polynomial_flatten(spark, d):
    from framelake.operators.background import surface

    z = s.px(spark, d).withColumn("surface", surface(F.array(F.lit(0.1), F.lit(0.02), F.lit(0.03)), 1, 8, 8))
    low = F.min("surface").over(Window.partitionBy("frame"))
    return z.select("frame", "y", "x", F.round(clamp(F.col("v") - F.col("surface") + low), 6).alias("v"))
