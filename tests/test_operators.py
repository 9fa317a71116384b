import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import stats
from framelake.operators import background, filters, folder, pixels, register, replay, session, sky, stack
from framelake.schema import Options


def one(df):
    return df.first()[0]


def test_median_conventions(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "v double")
    assert one(df.agg(stats.averaged_median("v"))) == 2.5
    assert one(df.agg(stats.upper_median("v"))) == 3.0
    assert one(df.agg(stats.nearest_rank("v", 0.2))) == 2.0


@pytest.mark.parametrize(
    "values, kept",
    [
        ([0.020, 0.020, 0.019, 0.019, 0.018, 0.060, 0.018, 0.018, 0.017, 0.017], [0, 1, 2, 3, 4, 6, 7, 8, 9]),
        ([0.030 - 0.0005 * i for i in range(20)], list(range(20))),
        ([0.35] * 8 + [0.001, 0.35], [*range(8), 9]),
        ([0.1, 0.9], [0, 1]),
        ([0.02] * 4 + [0.2] * 8, list(range(12))),
        ([0.02] * 4 + [0.2] * 3, list(range(7))),
    ],
)
def test_quality_gate(spark, values, kept):
    df = spark.createDataFrame([(values,)], "m array<double>")
    assert one(df.select(replay.gate(F.col("m")))) == kept


def test_keyframes(spark):
    df = spark.createDataFrame([(5,), (100,), (0,)], "n int")
    got = [r[0] for r in df.select(replay.log_keyframes(F.col("n"), 6)).collect()]
    assert got[0] == [0, 1, 2, 3, 4] and got[1][0] == 0 and got[1][-1] == 99 and got[2] == []
    assert one(df.where("n = 5").select(replay.log_keyframes(F.col("n"), 1))) == [0, 4]


def test_scale_factor(spark):
    rows = [(1, r, 1.0) for r in (0.5, 0.5, 0.5, 2.0, 2.0, 2.0)] + [(2, 3.0, 1.0)] * 4 + [(3, 9.0, 0.0)] * 6
    out = stack.scale_factor(spark.createDataFrame(rows, "frame int, ref_flux double, flux double"), ["frame"])
    assert {r.frame: (r.scale, r.n_ratios) for r in out.collect()} == {1: (1.25, 6), 2: (1.0, 4), 3: (1.0, 0)}


def fold(values, kappa=3.0, warm=8):
    n = mean = m2 = 0.0
    for v in values:
        if n >= max(2, warm):
            room = kappa * math.sqrt(m2 / n)
            v = min(max(v, mean - room), mean + room)
        n += 1
        d = v - mean
        mean += d / n
        m2 += d * (v - mean)
    return n, mean, m2


def test_clip_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0.5, 0.1, 40)
    v[[12, 30]] = 5.0
    df = spark.createDataFrame([(0, 0, 0, i, float(x), 1) for i, x in enumerate(v)], "c int, y int, x int, frame int, v double, m int").repartition(5)
    r = stack.winsor_clip(df, ["c", "y", "x"], "frame").first()
    assert (r.n, pytest.approx(r.mean, abs=1e-12), pytest.approx(r.m2, abs=1e-12)) == fold(v)


def test_ransac_and_umeyama_recover_a_transform(spark):
    rng = np.random.default_rng(3)
    s, a, tx, ty = 1.003, math.radians(0.4), 7.5, -3.25
    p = rng.uniform(0, 500, (30, 2))
    q = np.c_[s * (p[:, 0] * math.cos(a) - p[:, 1] * math.sin(a)) + tx, s * (p[:, 0] * math.sin(a) + p[:, 1] * math.cos(a)) + ty]
    q[25:] += 40  # false pairs
    rows = [(1, i, *map(float, p[i]), *map(float, q[i])) for i in range(30)] + [(2, i, 0.0, 0.0, 0.0, 0.0) for i in range(30)]
    pairs = spark.createDataFrame(rows, "frame int, ord int, x double, y double, u double, v double")
    got = register.ransac(pairs, ["frame"]).collect()
    assert [r.frame for r in got] == [1]
    r = got[0]
    assert abs(r.scale - s) < 1e-6 and abs(r.rotation - a) < 1e-6 and abs(r.tx - tx) < 1e-3 and abs(r.ty - ty) < 1e-3
    f = register.similarity_fit(pairs.where("ord < 25"), ["frame"]).where("frame = 1").first()
    assert abs(f.scale - s) < 1e-9 and abs(f.tx - tx) < 1e-6
    assert register.similarity_fit(pairs, ["frame"]).where("frame = 2").first().scale is None


def test_a_half_turn_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(7)
    p = rng.permutation(64)[:20]
    x, y = (p % 8) * 16.0, (p // 8) * 16.0
    rows = [(f, int(i), x[i], y[i], 112 - x[i], 112 - y[i]) for f in range(60) for i in rng.permutation(20)]
    pairs = spark.createDataFrame([(int(f), i, *map(float, r)) for f, i, *r in rows], "frame int, ord int, x double, y double, u double, v double").repartition(7, "ord")

    def comoment(a, b):
        ma = mb = c = 0.0
        for n, (s, t) in enumerate(zip(a, b), 1):
            d = s - ma
            ma, mb = ma + d / n, mb + (t - mb) / n
            c += d * (t - mb)
        return c / len(a)

    want = math.atan2(comoment(x, 112 - y) - comoment(y, 112 - x), -1)
    got = register.similarity_fit(pairs, ["frame"], ["ord"]).collect()
    assert len(got) == 60 and {round(r.rotation, 6) for r in got} == {round(want, 6)}


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    far = rng.uniform(-20, 20, (400, 2))
    knots = rng.uniform(-20, 20, (3, 2))[rng.integers(0, 3, 9000)] + rng.uniform(0, 1e-7, (9000, 2))
    o = np.r_[far, far[:50], knots, [[3.0, 0.0], [-3.0, 0.0], [np.nan, 1.0], [np.inf, 1.0], [1e300, 0.0]]]
    p = np.r_[rng.uniform(-23, 23, (150, 2)), knots[:20], far[:20], [[0.0, 0.0], [6.0, 0.0], [np.nan, 1.0], [1e300, 1.0]]]
    others = [(k, f"o{i:05d}", *map(float, v)) for i, v in enumerate(o) for k in (1, 2) if k == 1 or i % 7 == 0] + [(1, "null", None, 0.0)]
    points = [(k, n, i, *map(float, v)) for i, v in enumerate(p) for k in (1, 2, 3) for n in "ab"] + [(1, "a", 999, 0.0, None)]
    want = {}
    for k, n, i, x, y in points:
        if y is not None and n == "a":
            near = [(math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), name) for g, name, a, b in others if g == k and a is not None and abs(x - a) < 3 and abs(y - b) < 3]
            near = [v for v in near if v[0] < 3]
            if near:
                want[k, "a", i] = want[k, "b", i] = min(near)[::-1]
    df = spark.createDataFrame(points, "key int, frame string, id long, px double, py double")
    got = sky.nearest(df, spark.createDataFrame(others, "key int, other string, ox double, oy double"), ["key"], 3.0, keep=["frame"])
    assert got.columns == ["key", "frame", "id", "other", "distance"]
    rows = got.collect()
    assert len(rows) == len(want) and {(r.key, r.frame, r.id): (r.other, r.distance) for r in rows} == want


def test_nearest_does_not_meet_all_pairs_of_a_dense_spot(spark):
    n = 64
    grid = spark.range(n * n).selectExpr("1 as one", "id as other", f"(id % {n}) * 0.01D as ox", f"(id div {n}) * 0.01D as oy")
    near = sky.nearest(grid.selectExpr("one", "other as id", "ox + 0.002D as px", "oy - 0.003D as py"), grid, ["one"], 3.0)
    rows = near.collect()
    assert len(rows) == n * n and all(r.other == r.id and abs(r.distance - math.hypot(0.002, 0.003)) < 1e-12 for r in rows)

    def most(plan) -> int:
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return most(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return most(plan.plan())
        m, below = plan.metrics(), plan.children()
        return max([m.apply("numOutputRows").value() if m.contains("numOutputRows") else 0, *[most(below.apply(i)) for i in range(below.size())]])

    assert 0 < most(near._jdf.queryExecution().executedPlan()) <= 10 * n * n


def test_registration_from_stars(spark):
    rng = np.random.default_rng(5)
    ref = rng.uniform(20, 480, (15, 2))
    a = math.radians(0.1)
    src = np.c_[ref[:, 0] * math.cos(a) - ref[:, 1] * math.sin(a) + 4, ref[:, 0] * math.sin(a) + ref[:, 1] * math.cos(a) - 2]
    star = lambda f, p: [(f, 1, i, float(x), float(y), float(100 - i)) for i, (x, y) in enumerate(p)]
    stars = spark.createDataFrame(star(0, ref) + star(1, src), "frame int, session int, star long, sx double, sy double, flux double")
    votes = register.triangle_votes(register.triangles(stars, ["frame", "session"]), register.triangles(stars.where("frame = 0"), ["session"]), ["frame"], ["session"])
    got = register.greedy_match(votes, ["frame"]).where("frame = 1").collect()
    assert len(got) >= 12 and all(r.src == r.dst for r in got)


def plane(a):
    return [list(map(float, a.ravel()))]


def test_star_detect(spark):
    y, x = np.mgrid[0:128, 0:128]
    rng = np.random.default_rng(0)
    a = 0.05 + rng.normal(0, 0.001, (128, 128))
    places = [(30.0, 40.0), (90.3, 70.6), (60.0, 100.0)]
    for i, (cx, cy) in enumerate(places):
        a += (0.9 - 0.2 * i) * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 9))
    df = spark.createDataFrame([(1, 128, 128, a.ravel().tolist())], "frame int, width int, height int, pixels array<double>")
    got = register.star_detect(df, ["frame"]).orderBy("star").collect()
    assert len(got) == 3
    for r, (cx, cy) in zip(got, places):
        assert abs(r.sx - cx) < 0.3 and abs(r.sy - cy) < 0.3


def test_components_equals_flood_fill():
    rng = np.random.default_rng(2)
    mask = rng.random((20, 23)) < 0.5
    labels = register.components(mask)
    seen = {}
    for y, x in zip(*np.nonzero(mask)):
        for dy, dx in ((0, 1), (1, 0)):
            if y + dy < 20 and x + dx < 23 and mask[y + dy, x + dx]:
                assert labels[y, x] == labels[y + dy, x + dx]
        seen.setdefault(labels[y, x], (y, x))
    todo, parts = {tuple(p) for p in np.argwhere(mask).tolist()}, 0
    while todo:
        parts += 1
        heap = [todo.pop()]
        while heap:
            y, x = heap.pop()
            for n in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                if n in todo:
                    todo.remove(n)
                    heap.append(n)
    assert parts == len(seen)


def test_denoise_and_flatten(spark):
    rng = np.random.default_rng(4)
    a = 0.2 + rng.normal(0, 0.02, (3, 256, 320))
    df = spark.createDataFrame([(1, 320, 256, True, [p.ravel().tolist() for p in a])], "frame int, width int, height int, linear boolean, pixels array<array<double>>")
    assert filters.denoise(df, ["frame"], 0.0) is df
    out = np.array(filters.denoise(df, ["frame"], 0.5).first().pixels)
    luma = lambda p: (p[0] + 2 * p[1] + p[2]) / 4
    assert luma(out).std() < 0.8 * luma(a.reshape(3, -1)).std() and abs(out.mean() - a.mean()) < 1e-3
    small = spark.createDataFrame([(1, 4, 4, True, [[0.5] * 16])], df.schema)
    assert filters.denoise(small, ["frame"], 0.5).first().pixels == [[0.5] * 16]
    y, x = np.mgrid[0:64, 0:64]
    sky_ = 0.1 + 0.003 * x + rng.normal(0, 0.001, (64, 64))
    planes = spark.createDataFrame([(1, 64, 64, sky_.ravel().tolist())], "frame int, width int, height int, pixels array<double>")
    flat = np.array(background.flatten_multiscale(planes, ["frame"], 10).first().pixels).reshape(64, 64)
    assert np.ptp(flat.mean(0)) < 0.3 * np.ptp(sky_.mean(0))


def test_box_blur_repeats_edges(spark):
    rng = np.random.default_rng(6)
    a = rng.random((7, 9))
    p = np.pad(a, 2, mode="edge")
    want = np.array([[p[y : y + 5, x : x + 5].mean() for x in range(9)] for y in range(7)])
    assert np.allclose(background.box_blur(a, 2), want)
    df = spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(7) for x in range(9)], "k int, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in filters.box_blur_long(df, ["k"], 2, 9, 7).collect()}
    assert np.allclose([[got[y, x] for x in range(9)] for y in range(7)], want)


def test_surface_fit(spark):
    rows = [(1, y, x, 0.3 + 0.1 * (x / 10 * 2 - 1) - 0.2 * (y / 10 * 2 - 1) ** 2) for y in range(10) for x in range(10)]
    df = spark.createDataFrame(rows, "k int, y int, x int, v double")
    c = background.surface_fit(df, ["k"], 2, 10, 10).first().coefficients
    assert np.allclose(c, [0.3, 0.1, 0, 0, 0, -0.2], atol=1e-9)
    assert background.surface_fit(df.where("y = 0 and x = 0"), ["k"], 1, 10, 10).first().coefficients is None
    spiked = df.union(spark.createDataFrame([(1, 3, 3, 50.0)], df.schema))
    assert background.clip_high(spiked, ["k"]).agg(F.max("v")).first()[0] < 1


def test_cone_crosses_the_seam(spark):
    cat = spark.createDataFrame([(359.9, 0.0, 1.0), (0.1, 0.0, 1.0), (180.0, 0.0, 1.0)], "ra double, dec double, mag double")
    assert {r.ra for r in sky.cone(cat, 0.0, 0.0, 0.5).collect()} == {359.9, 0.1}
    xi, eta = sky.project(F.col("ra"), F.col("dec"), 10.0, 20.0)
    ra, dec = sky.deproject(F.col("xi"), F.col("eta"), 10.0, 20.0)
    r = spark.createDataFrame([(11.25, 20.5)], "ra double, dec double").select(xi.alias("xi"), eta.alias("eta")).select(ra.alias("ra"), dec.alias("dec")).first()
    assert abs(r.ra - 11.25) < 1e-9 and abs(r.dec - 20.5) < 1e-9
    w = spark.createDataFrame([(190.0,), (-180.0,), (180.0,)], "a double").select(sky.wrap_angle(F.col("a")))
    assert [x[0] for x in w.collect()] == [-170.0, 180.0, 180.0]


def test_plate_solve(spark):
    rng = np.random.default_rng(8)
    cat = [(10 + float(u) / math.cos(math.radians(20)), 20 + float(v), float(m)) for u, v, m in zip(rng.uniform(-0.5, 0.5, 25), rng.uniform(-0.5, 0.5, 25), rng.uniform(5, 8, 25))]
    c = spark.createDataFrame(cat, "ra double, dec double, mag double")
    xi, eta = sky.project(F.col("ra"), F.col("dec"), 10.0, 20.0)
    k = 3600 * math.degrees(1) / 4.0
    seen = c.select((500 + xi * k * 0.999 + 3).alias("sx"), (500 - eta * k * 0.999 - 2).alias("sy"), sky.magnitude_flux(F.col("mag")).alias("flux")).toPandas().sort_values("flux", ascending=False)
    stars = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(seen.to_numpy())], "frame int, star long, sx double, sy double, flux double")
    got = sky.plate_solve(stars, c, 10.0, 20.0, 1000, 1000, 4.0, most=14).collect()
    assert [(r.frame, r.mirrored) for r in got] == [(1, False)]
    assert abs(got[0].scale - 1 / 0.999) < 1e-3 and got[0].inliers == 25  # more than the 14 that made triangles
    # The frame's centre lies 3 pixels left of and 2 above the field's, at 4 seconds a pixel.
    assert abs((got[0].center_ra - 10) * math.cos(math.radians(20)) * 900 + 3) < 0.1 and abs((got[0].center_dec - 20) * 900 + 2) < 0.1


def test_plate_solve_of_turned_mirrored_and_crowded_frames(spark):
    rng = np.random.default_rng(9)
    cat = [(10 + float(u) / math.cos(math.radians(20)), 20 + float(v), float(m)) for u, v, m in zip(rng.uniform(-0.4, 0.4, 40), rng.uniform(-0.4, 0.4, 40), rng.uniform(6, 9, 40))]
    # Bright stars that no turn of the frame can show.
    cat += [(10 + 0.9 * math.cos(t) / math.cos(math.radians(20)), 20 + 0.9 * math.sin(t), 1.0) for t in np.linspace(0, 6, 30)]
    c = spark.createDataFrame(cat, "ra double, dec double, mag double")
    xi, eta = sky.project(F.col("ra"), F.col("dec"), 10.0, 20.0)
    k = 3600 * math.degrees(1) / 4.0
    grid = c.where("mag > 2").select((xi * k).alias("x"), (-eta * k).alias("y"), sky.magnitude_flux(F.col("mag")).alias("flux")).toPandas()
    rows, turn = [], math.radians(30)
    for frame, flip in ((1, 1), (2, -1)):
        # Fitted is frame to grid: the frame shows the grid turned back by 30 degrees.
        x, y = flip * grid["x"], grid["y"]
        sx, sy = 500 + math.cos(turn) * x + math.sin(turn) * y, 500 - math.sin(turn) * x + math.cos(turn) * y
        order = rng.permutation(len(grid))  # not by brightness
        rows += [(frame, i, float(sx[j]), float(sy[j]), float(grid["flux"][j])) for i, j in enumerate(order)]
    got = {r.frame: r for r in sky.plate_solve(spark.createDataFrame(rows, "frame int, star long, sx double, sy double, flux double"), c, 10.0, 20.0, 1000, 1000, 4.0, most=14).collect()}
    assert {f: r.mirrored for f, r in got.items()} == {1: False, 2: True}
    assert all(abs(r.rotation_degrees - 30) < 0.05 and r.inliers == 40 and abs(r.center_ra - 10) < 1e-3 and abs(r.center_dec - 20) < 1e-3 for r in got.values())


def test_session_texts(spark):
    df = spark.createDataFrame([(8040.0, 402, 20.0), (90.0, 3, 30.0), (120.0, 6, 20.0), (5.0, 2, 2.5)], "s double, n int, e double")
    assert [r[0] for r in df.select(session.caption(F.col("s"), F.col("n"), F.col("e"))).collect()] == ["2h 14m · 402 × 20s", "1m 30s · 3 × 30s", "2m · 6 × 20s", "5s · 2 × 2.5s"]
    s = spark.createDataFrame([("M 31 -- Andromeda!",), ("***",), ("a" * 40,)], "n string").select(session.slug(F.col("n")))
    assert [r[0] for r in s.collect()] == ["m-31-andromeda", "session", "a" * 24]


def test_options_survive_older_documents():
    o = Options.from_json('{"saturation": 1.5, "unknown": 3, "denoise": null}')
    assert o.saturation == 1.5 and o.denoise == 0.0 and Options.from_json(o.to_json()) == o


def test_display_order(spark):
    rng = np.random.default_rng(3)
    rows = [(0, c, y, x, float(0.1 + 0.05 * c + 0.02 * rng.random())) for c in range(3) for y in range(12) for x in range(12)]
    px = spark.createDataFrame(rows, "image int, c int, y int, x int, v double")
    flat = {(r.c, r.y, r.x): r.v for r in pixels.display(px, ["image"], 12, 12, linear=False, flattened=True).collect()}
    med = [np.median([v for (c, _, _), v in flat.items() if c == k]) for k in range(3)]
    assert len(flat) == len(rows) and np.allclose(med, med[1])
    grey = pixels.display(px, ["image"], 12, 12, factor=0.0, tiles=4).groupBy("y", "x").agg((F.max("v") - F.min("v")).alias("d"), F.min("v").alias("low"), F.max("v").alias("high"))
    assert grey.where("d > 1e-9 or low < 0 or high > 1").count() == 0 and grey.count() == 144


def test_dilation_stays_inside(spark):
    got = pixels.dilate(spark.createDataFrame([(1, 0, 0), (1, 3, 3)], "frame int, y int, x int"), ["frame"], 4, 4)
    assert {(r.y, r.x) for r in got.collect()} == {(0, 0), (0, 1), (1, 0), (3, 3), (2, 3), (3, 2)}


def test_directory_footprint(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, size in (("a.fit", 10), ("deep/b.fit", 20), ("deep/c.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert tuple(folder.directory_footprint(spark, str(tmp_path)).first()) == (3, 35)


def test_planes_need_no_shuffle_and_equal_the_long_forms(spark):
    from framelake.operators import planes

    rng = np.random.default_rng(4)
    images = [(k, 9, 7, [float(v) for v in rng.random(63)], 1.02, 0.1 * k, 0.4, -0.3) for k in range(3)]
    df = spark.createDataFrame(images, "frame int, width int, height int, pixels array<double>, scale double, rotation double, tx double, ty double")
    long = planes.long_view(df, ["frame"], ["pixels"]).withColumnRenamed("pixels", "v")
    rows = lambda d, c: {(r.frame, r.y, r.x): tuple(round(r[k], 9) for k in c) for r in d.collect()}
    cases = [(planes.debayer_bilinear(df, "GRBG"), filters.debayer_bilinear(long, ["frame"], "GRBG", 9, 7), ["r", "g", "b"]), (planes.debayer_malvar(df, "GBRG", 5), filters.debayer_malvar(long, ["frame"], "GBRG", 9, 7, 5), ["r", "g", "b"]),
             (planes.warp_bilinear(df), register.warp_bilinear(long, df.select("frame", "scale", "rotation", "tx", "ty"), ["frame"], 9, 7), ["v", "m"])]
    for ours, theirs, columns in cases:
        seen = planes.long_view(ours, ["frame"], columns)
        assert "Exchange" not in seen._jdf.queryExecution().executedPlan().toString()
        assert rows(seen, columns) == rows(theirs, columns)
    none = df.withColumn("pixels", F.when(F.col("frame") > 0, F.col("pixels")))
    assert [r.r is None for r in planes.debayer_bilinear(none, "RGGB").orderBy("frame").collect()] == [True, False, False]
    assert planes.debayer_malvar(df.limit(0), "RGGB").count() == 0
