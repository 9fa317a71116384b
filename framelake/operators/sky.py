"""Sky geometry: cones, gnomonic projection, nearest neighbours, plate solving."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators import register


def cone(catalog: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Stars within radius degrees. The declination band is pushed to the scan; the dot product decides."""
    c = [math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec))]
    r, d = F.radians("ra"), F.radians("dec")
    dot = F.cos(d) * F.cos(r) * c[0] + F.cos(d) * F.sin(r) * c[1] + F.sin(d) * c[2]
    return catalog.where(F.col("dec").between(dec - radius, dec + radius)).where(dot >= math.cos(math.radians(radius)))


def project(ra: Column, dec: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Tangent-plane xi, eta in radians; null behind the plane."""
    d0, r = math.radians(dec0), F.radians(ra) - math.radians(ra0)
    d = F.radians(dec)
    cos_c = math.sin(d0) * F.sin(d) + math.cos(d0) * F.cos(d) * F.cos(r)
    ok = cos_c > 1e-9
    return F.when(ok, F.cos(d) * F.sin(r) / cos_c), F.when(ok, (math.cos(d0) * F.sin(d) - math.sin(d0) * F.cos(d) * F.cos(r)) / cos_c)


def deproject(xi: Column, eta: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """ra in [0, 360) and dec of a tangent-plane position."""
    d0 = math.radians(dec0)
    den = math.cos(d0) - eta * math.sin(d0)
    ra = F.pmod(F.lit(ra0) + F.degrees(F.atan2(xi, den)), F.lit(360.0))
    return ra, F.degrees(F.atan2(math.sin(d0) + eta * math.cos(d0), F.sqrt(xi * xi + den * den)))


#: Others in a tile and in a block of it, points of a tile that one task takes, points compared at once. SLACK covers rounding of bounds.
TILE, BLOCK, LOAD, BATCH, SLACK = 4096, 64, 65536, 1024, 1 + 1e-12


def _spread(c: Column) -> Column:
    """The low 32 bits of c at the even places."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
    return c


def _nearest_of_tile(px: np.ndarray, py: np.ndarray, bound: np.ndarray, ox: np.ndarray, oy: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest other of each point, of equally near ones the first by order, and its distance; infinite where none is within bound.

    Others lie in runs of neighbours. A block of them is looked at only where its box is no farther than the bound or than the far corner of another's box.
    """
    starts = np.arange(0, len(ox), BLOCK)
    x0, x1, y0, y1 = (f.reduceat(c, starts) for c in (ox, oy) for f in (np.minimum, np.maximum))
    pad = (0, -len(ox) % BLOCK)
    bx, by = (np.pad(c, pad, constant_values=np.inf).reshape(-1, BLOCK) for c in (ox, oy))
    rank = np.pad(np.argsort(order), pad, constant_values=len(ox)).reshape(-1, BLOCK)
    at, dist = np.zeros(len(px), int), np.full(len(px), np.inf)
    for k in range(0, len(px), BATCH):
        x, y = px[k : k + BATCH, None], py[k : k + BATCH, None]
        low = np.hypot(np.maximum(np.maximum(x0 - x, x - x1), 0), np.maximum(np.maximum(y0 - y, y - y1), 0))
        far = np.hypot(np.maximum(np.abs(x - x0), np.abs(x - x1)), np.maximum(np.abs(y - y0), np.abs(y - y1)))
        i, b = np.nonzero(low <= np.minimum(bound[k : k + BATCH], far.min(1) * SLACK)[:, None])
        if not len(i):
            continue
        dx, dy = x[i] - bx[b], y[i] - by[b]
        d = np.sqrt(dx * dx + dy * dy)
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        best = np.minimum.reduceat(d.min(1), first)
        tied = d == np.repeat(best, np.diff(np.r_[first, len(i)]))[:, None]
        dist[k + i[first]], at[k + i[first]] = best, np.minimum.reduceat(np.where(tied, rank[b], len(ox)).min(1), first)
    return order[np.minimum(at, len(ox) - 1)], dist


def nearest(points: DataFrame, others: DataFrame, keys: list[str], radius: float, keep: list[str] = ()) -> DataFrame:
    """For each point the nearest other strictly within radius; of equally near ones the least.

    points: keys, id, px, py, and keep, which are part of a point's name; others: keys, other, ox, oy; keys have few values.
    Others are cut into tiles of at most TILE neighbours, in Z-order within cells of at least the radius. A point
    goes to those tiles of its 3 x 3 cells whose box is no farther than the radius or than the far corner of any
    one's box, and meets its nearest in each; so its work does not grow with what lies within the radius. A tile
    with many points near it is copied, and each copy takes a share of them.
    """
    finite = lambda *c: F.greatest(*[F.abs(F.col(x)) for x in c]) < math.inf
    name = [*keys, *keep, "id"]
    o = others.select(*[F.col(k).alias(k) for k in keys], "other", *[F.col(c).cast("double") for c in ("ox", "oy")]).where("ox is not null and oy is not null").where(finite("ox", "oy"))
    o = o.groupBy(*keys, "ox", "oy").agg(F.min("other").alias("other"))
    p = points.select(*name, *[F.col(c).cast("double") for c in ("px", "py")]).where("px is not null and py is not null").where(finite("px", "py"))
    # A cell is so wide that it would hold half a tile if others lay evenly.
    wide = F.sqrt((F.max("ox") - F.min("ox")) * (F.max("oy") - F.min("oy")) * (TILE / 2) / F.count("*"))
    side = F.broadcast(o.groupBy(*keys).agg(F.greatest(F.lit(radius * (1 + 1e-9)), wide).alias("_side")))
    cell = lambda c: F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.col(c) / F.col("_side"))))
    o = o.join(side, keys).withColumns({"_cx": cell("ox"), "_cy": cell("oy")})
    p = p.repartition(*name).join(side, keys).withColumns({"_cx": cell("px"), "_cy": cell("py")}).drop("_side")
    here = [*keys, "_cx", "_cy"]
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = lambda df: df.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}).drop("_dx", "_dy")
    bits = lambda c, at: _spread(F.greatest(F.lit(0), F.least(F.lit(2**30 - 1), F.floor((F.col(c) / F.col("_side") - F.col(at)) * 2**30))))
    z = F.shiftleft(bits("oy", "_cy"), 1).bitwiseOR(bits("ox", "_cx"))
    o = o.withColumn("_r", F.row_number().over(Window.partitionBy(*here).orderBy(z, "ox", "oy")) - 1).withColumn("_tile", F.expr(f"_r div {TILE}"))
    load = around(p.groupBy(*here).agg(F.count("*").alias("_n"))).groupBy(*here).agg(F.ceil(F.sum("_n") / LOAD).cast("int").alias("_parts"))
    tiles = o.groupBy(*here, "_tile").agg(F.min("ox").alias("x0"), F.max("ox").alias("x1"), F.min("oy").alias("y0"), F.max("oy").alias("y1")).join(load, here)
    tiles = around(tiles.withColumn("_t", F.struct(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), "_tile", "_parts", "x0", "x1", "y0", "y1")).select(*here, "_t"))
    tiles = tiles.groupBy(*here).agg(F.collect_list("_t").alias("_t"))
    px, py = F.col("px"), F.col("py")
    low = lambda t: F.hypot(F.greatest(t["x0"] - px, px - t["x1"], F.lit(0.0)), F.greatest(t["y0"] - py, py - t["y1"], F.lit(0.0)))
    far = lambda t: F.hypot(F.greatest(F.abs(px - t["x0"]), F.abs(px - t["x1"])), F.greatest(F.abs(py - t["y0"]), F.abs(py - t["y1"])))
    m = p.join(tiles, here).drop("_cx", "_cy").withColumn("_bound", SLACK * F.least(F.lit(radius), F.array_min(F.transform("_t", far))))
    m = m.withColumn("_t", F.explode(F.filter("_t", lambda t: low(t) <= F.col("_bound"))))
    group = [*here, "_tile", "_part"]
    m = m.select(*name, "px", "py", "_bound", F.col("_t.cx").alias("_cx"), F.col("_t.cy").alias("_cy"), "_t._tile", F.expr("pmod(xxhash64(%s), _t._parts)" % ", ".join(f"`{c}`" for c in (*keep, "id"))).cast("int").alias("_part"))
    o = o.join(load, here).select(*here, "_tile", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_r", "ox", "oy", "other")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[name].head(0).assign(other=right["other"].head(0), distance=0.0)
        right = right.sort_values("_r", ignore_index=True)
        at, dist = _nearest_of_tile(*(left[c].to_numpy() for c in ("px", "py", "_bound")), *(right[c].to_numpy() for c in ("ox", "oy")), right["other"].argsort(kind="stable").to_numpy())
        out = left[name].reset_index(drop=True).assign(other=right["other"].take(at).reset_index(drop=True), distance=dist)
        return out[out["distance"] < radius]

    schema = T.StructType([*m.select(*name).schema.fields, o.schema["other"], T.StructField("distance", T.DoubleType())])
    found = m.groupBy(*group).cogroup(o.groupBy(*group)).applyInPandas(meet, schema)
    best = F.min(F.struct("distance", "other")).alias("b")
    return found.groupBy(*name).agg(best).select(*name, "b.other", "b.distance")


def magnitude_flux(mag: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * mag)


def wrap_angle(degrees: Column) -> Column:
    """Into (-180, 180]."""
    return 180.0 - F.pmod(180.0 - degrees, F.lit(360.0))


def north_up(rotation: Column, width: Column, height: Column, auto_zoom: bool = True, most: float = 15.0) -> Column:
    """The canvas of a frame turned by rotation degrees: struct(out_width, out_height, zoom).

    Small turns keep the frame's size and zoom until no corner is empty; larger ones, or
    all without auto_zoom, get the whole turned box.
    """
    c, s = F.abs(F.cos(F.radians(rotation))), F.abs(F.sin(F.radians(rotation)))
    small = (F.abs(wrap_angle(rotation)) <= most) & F.lit(auto_zoom)
    side = lambda own, a, b: F.greatest(F.lit(1), F.round(F.when(small, own.cast("double")).otherwise(a + b)).cast("long"))
    zoom = F.when(small, c + F.greatest(width / height, height / width) * s).otherwise(1.0)
    return F.struct(side(width, width * c, height * s).alias("out_width"), side(height, width * s, height * c).alias("out_height"), zoom.alias("zoom"))


#: Stars and tolerance of the triangle match, reach of the frame from its centre in half diagonals, and of the catalog cone, inlier radius in pixels.
SOLVE_STARS, SOLVE_TOLERANCE, REACH, CONE_REACH, INLIER_PIXELS = 40, 0.01, 1.1, 1.2, 3.0


def plate_solve(stars: DataFrame, catalog: DataFrame, ra: float, dec: float, width: float, height: float, scale: float, most: int = SOLVE_STARS, least: int = 8) -> DataFrame:
    """(frame, scale, rotation, tx, ty, inliers, mirrored, center_ra, center_dec, rotation_degrees) of each frame that solves.

    stars: frame, star, sx, sy, flux; scale is arcseconds a pixel. Catalog stars that some
    turn of the frame can show are projected to its pixels, in either parity, and the
    brightest are matched with the frame's brightest by triangles. The parity with more
    inliers wins; once more every star is paired with the nearest catalog star under that
    solution and fitted, which is taken where it has more inliers. Equal counts go to the plain parity.
    """
    half = 0.5 * math.hypot(width, height)
    xi, eta = project(F.col("ra"), F.col("dec"), ra, dec)
    k = 3600 * math.degrees(1) / scale
    near = cone(catalog, ra, dec, CONE_REACH * half * scale / 3600).withColumns({"xi": xi * k, "eta": eta * k, "flux": magnitude_flux(F.col("mag"))})
    near = near.where(F.hypot("xi", "eta") <= REACH * half)
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("mirrored")
    grid = near.select("flux", "xi", "eta", both).select("mirrored", "flux", (width / 2 + F.when(F.col("mirrored"), -F.col("xi")).otherwise(F.col("xi"))).alias("sx"), (height / 2 - F.col("eta")).alias("sy"))
    rank = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("flux"), "sx", "sy")).cast("long") - 1
    grid = grid.withColumn("star", rank(["mirrored"]))
    ours = stars.withColumnRenamed("star", "_id").withColumn("star", rank(["frame"]))
    t = register.triangles(grid.where(F.col("star") < most), ["mirrored"], most)
    s = register.triangles(ours.where(F.col("star") < most).select("frame", "star", "sx", "sy", "flux"), ["frame"], most).withColumn("mirrored", both)
    votes = register.triangle_votes(s, t, ["frame"], ["mirrored"], SOLVE_TOLERANCE, keep=["mirrored"])
    keys = ["frame", "mirrored"]
    src = ours.select("frame", F.col("star").alias("src"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    dst = grid.select("mirrored", F.col("star").alias("dst"), F.col("sx").alias("u"), F.col("sy").alias("v"))
    pairs = register.greedy_match(votes, keys).join(src, ["frame", "src"]).join(dst, ["mirrored", "dst"]).withColumn("ord", F.col("src"))
    first = _counted(register.ransac(pairs, keys), pairs, keys)
    order = F.struct("inliers", (~F.col("mirrored")).alias("plain"))
    names = ["mirrored", "scale", "rotation", "tx", "ty", "inliers"]
    best = first.groupBy("frame").agg(F.max_by(F.struct(*names), order).alias("b")).select("frame", "b.*").where(F.col("inliers") >= least)
    # Every star against the whole grid, under the first solution.
    u, v = register.transform(F.col("x"), F.col("y"))
    moved = src.join(best, "frame").select("frame", "mirrored", F.col("src").alias("id"), "x", "y", u.alias("px"), v.alias("py"))
    found = nearest(moved, dst.select("mirrored", F.col("dst").alias("other"), F.col("u").alias("ox"), F.col("v").alias("oy")), ["mirrored"], INLIER_PIXELS, keep=["frame"])
    more = found.withColumnsRenamed({"id": "src", "other": "dst"}).join(src, ["frame", "src"]).join(dst, ["mirrored", "dst"]).withColumn("ord", F.col("src"))
    again = _counted(register.ransac(more, keys, least), more, keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in names[1:]])
    better = F.coalesce(F.col("_inliers") > F.col("inliers"), F.lit(False))
    won = best.join(again, keys, "left").select(*keys, *[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names[1:]])
    gx, gy = register.transform(F.lit(width / 2), F.lit(height / 2))
    off = F.when(F.col("mirrored"), -(gx - width / 2)).otherwise(gx - width / 2)
    ra_, dec_ = deproject(off / k, (height / 2 - gy) / k, ra, dec)
    return won.select("frame", *names[1:], "mirrored", ra_.alias("center_ra"), dec_.alias("center_dec"), wrap_angle(F.degrees("rotation")).alias("rotation_degrees"))


def _counted(fits: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """fits with the number of their pairs that lie within the inlier radius."""
    u, v = register.transform(F.col("x"), F.col("y"))
    met = pairs.join(fits, keys).where(F.hypot(u - F.col("u"), v - F.col("v")) < INLIER_PIXELS)
    return fits.join(met.groupBy(*keys).agg(F.count("*").alias("inliers")), keys)
