"""Elimination, messages, table functions, and whole display and master orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import tables
from framelake.operators import background, filters, pixels, stack
from framelake.sources import config, fits
from framelake.streaming import live


def by_hand(m):
    """Elimination with partial pivoting; None where a pivot is under 1e-12."""
    m = [list(map(float, r)) for r in m]
    n = len(m)
    for c in range(n):
        best = max(range(c, n), key=lambda r: (abs(m[r][c]), -r))
        if abs(m[best][c]) < 1e-12:
            return None
        m[c], m[best] = m[best], m[c]
        for r in range(c + 1, n):
            f = m[r][c] / m[c][c]
            m[r] = [a - f * b for a, b in zip(m[r], m[c])]
    x = [0.0] * n
    for r in range(n - 1, -1, -1):
        s = m[r][n]
        for k in range(r + 1, n):
            s -= m[r][k] * x[k]
        x[r] = s / m[r][r]
    return x


@pytest.mark.parametrize("n", [1, 3, 6])
def test_elimination_equals_the_plain_loop(spark, n):
    rng = np.random.default_rng(n)
    rows = []
    for k in range(24):
        a = rng.standard_normal((n, n))
        a = a @ a.T
        if k % 6 == 1:
            a *= 1e-13 / np.abs(a).max()  # every pivot is too small, though the system has an answer
        if k % 6 == 2:
            a *= 10.0 ** rng.integers(-5, 6)  # a determinant far under 1e-12 is fine if the pivots aren't
        if k % 6 == 3:
            a[-1] = a[0]
        if k % 6 == 4:
            a[0, 0] = 0.0
        rows.append((k, np.column_stack([a, rng.standard_normal(n)]).tolist()))
    got = {r.k: r.x for r in spark.createDataFrame(rows, "k int, m array<array<double>>").select("k", background.solved(F.col("m"), n).alias("x")).collect()}
    for k, m in rows:
        want = by_hand(m)
        assert (got[k] is None) == (want is None), (k, got[k], want)
        assert want is None or np.allclose(got[k], want, rtol=1e-9, atol=0)
    assert any(x is None for x in got.values()) and any(x is not None for x in got.values())


def test_surfaces_without_enough_points_are_null(spark):
    px = spark.createDataFrame([(f, y, x, 0.1 * x + 0.01 * y * y) for f in (0, 1) for y in range(8) for x in range(8) if f == 0 or x == 3], "frame int, y int, x int, v double")
    got = {r.frame: r.coefficients for r in background.surface_fit(px, ["frame"], 2, 8, 8).collect()}
    assert got[1] is None
    z = {(r.y, r.x): r.z for r in px.where("frame = 0").select("y", "x", background.surface(F.array(*map(F.lit, got[0])), 2, 8, 8).alias("z")).collect()}
    assert all(abs(z[y, x] - (0.1 * x + 0.01 * y * y)) < 1e-9 for y in range(8) for x in range(8))


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"op":0,"d":{"rpcVersion":1}}', (False, "hello", 1, None)),
        ('{"op":0,"d":{"rpcVersion":1,"authentication":{"challenge":"c","salt":"s"}}}', (False, "hello", 1, "c")),
        ('{"op":0,"d":{"rpcVersion":1,"authentication":{"challenge":"c"}}}', (False, "unknown", None, None)),
        ('{"op":0}', (False, "unknown", None, None)),
        ('{"op":2}', (False, "identified", None, None)),
        ('{"op":5,"d":{"eventType":3}}', (False, "unknown", None, None)),
        ('{"op":6,"d":{}}', (False, "unknown", None, None)),
        ('{"op":"5"}', (True, "unknown", None, None)),
        ('{"op":1.5}', (True, "unknown", None, None)),
        ("[1, 2]", (True, "unknown", None, None)),
        ("nonsense", (True, "unknown", None, None)),
        (None, (True, "unknown", None, None)),
    ],
)
def test_messages(spark, text, want):
    m = spark.createDataFrame([(text,)], "t string").select(config.message(F.col("t")).alias("m")).first().m
    assert (m.malformed, m.kind, m.rpc_version, m.challenge) == want


def test_events_and_responses_carry_their_data(spark):
    t = ['{"op":5,"d":{"eventType":"E","eventData":{"a":[1]}}}', '{"op":5,"d":{"eventType":"E"}}', '{"op":7,"d":{"requestId":"i","requestType":"T","requestStatus":{"result":false,"code":604,"comment":"no"},"responseData":{"b":2}}}']
    a, b, c = (r.m for r in spark.createDataFrame([(x,) for x in t], "t string").select(config.message(F.col("t")).alias("m")).collect())
    assert (a.kind, a.type, a.data) == ("event", "E", '{"a":[1]}') and (b.kind, b.data) == ("event", None)
    assert (c.kind, c.type, c.request_id, c.ok, c.code, c.comment, c.data) == ("response", "T", "i", False, 604, "no", '{"b":2}')


def test_table_functions_from_sql(spark):
    tables.register(spark)
    head = fits.encode(np.zeros((1, 2, 2), np.float32), 3, 60.0, {"OBJECT": "it's M31"})
    spark.createDataFrame([("a", bytearray(head)), ("b", bytearray(b"cut")), ("c", None)], "path string, head binary").createOrReplaceTempView("heads")
    got = spark.sql("SELECT path, t.* FROM heads, LATERAL fits_cards(head) t ORDER BY pos").collect()
    assert [r.path for r in got] == ["a"] * len(got) and dict((r.key, r.value) for r in got)["OBJECT"] == "it's M31" and got[0].key == "SIMPLE"
    spark.createDataFrame([(1, 0, "quote", 0, "x"), (1, 1, "quote", 0, "y"), (1, 2, "blank", 0, ""), (1, 3, "quote", 0, "z"), (1, 4, "heading", 2, "h"), (1, 5, "heading", 1, "i"), (2, 0, "blank", 0, "")], "doc long, pos int, kind string, level int, text string").createOrReplaceTempView("md")
    got = spark.sql("SELECT * FROM md_blocks(TABLE(md) PARTITION BY doc ORDER BY pos) ORDER BY block").collect()
    assert [tuple(r) for r in got] == [(1, 1, "quote", 0, "x\ny", 2), (1, 2, "quote", 0, "z", 1), (1, 3, "heading", 2, "h", 1), (1, 4, "heading", 1, "i", 1)]


def image(seed, side):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:side, 0:side]
    return np.stack([0.1 + 0.03 * c + 0.1 * x / side + 0.02 * rng.random((side, side)) for c in range(3)]).clip(0, 1)


def long(spark, a):
    return spark.createDataFrame([(0, c, y, x, float(a[c, y, x])) for c in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])], "image int, c int, y int, x int, v double")


def back(df, side):
    out = np.full((3, side, side), np.nan)
    for r in df.collect():
        out[r.c, r.y, r.x] = r.v
    return out


def test_planes_round_trip(spark):
    a = image(0, 9)
    planes = pixels.to_planes(long(spark, a), ["image"], 9, 9)
    assert np.array_equal(np.array(planes.first().pixels).reshape(3, 9, 9), a)
    assert np.array_equal(back(pixels.from_planes(planes, ["image"]), 9), a)


def test_display_takes_every_step_in_order(spark):
    """Flatten, gains, stretch, denoise, saturation and packing against the same steps one by one."""
    side = 64
    a = image(3, side)
    ours = back(pixels.display(long(spark, a), ["image"], side, side, factor=1.5, flatten=(20.0, 0.5), noise=0.5, black=0.02, strength=0.3, pack=True), side)
    flat = np.stack([np.clip(p - m + m.min(), 0, 1) for p in a for m in [background.multiscale_model(p, 20.0, 0.5)]])
    step = pixels.auto_stretch(pixels.neutralize_mul(long(spark, flat), ["image"]), ["image"], black=0.02, strength=0.3)
    still = back(step, side)
    planes = spark.createDataFrame([(0, side, side, False, [p.ravel().tolist() for p in still])], "image int, width int, height int, linear boolean, pixels array<array<double>>")
    calm = np.array(filters.denoise(planes, ["image"], 0.5).first().pixels).reshape(3, side, side)
    luma = (np.array(pixels.LUMA)[:, None, None] * calm).sum(0)
    want = np.clip(luma + (calm - luma) * 1.5, 0, 1) * 255
    assert (np.abs(ours - np.floor(want)) <= (np.abs(want - np.round(want)) < 1e-6)).all()
    assert not np.allclose(calm, still) and np.ptp(flat[0].mean(0)) < np.ptp(a[0].mean(0))
    raw = back(pixels.display(long(spark, a), ["image"], side, side, linear=False, neutralize=False), side)
    assert np.allclose(raw, a)  # nothing asked for, nothing done


def test_master_is_cropped_neutralized_written_and_then_committed(spark, tmp_path):
    a = image(5, 12)
    a[1] += 0.05
    rows = [(7, f, c, y, x, float(a[c, y, x]), int(not (x == 0 and f))) for f in range(3) for c in range(3) for y in range(12) for x in range(12)]
    px = spark.createDataFrame(rows, "session long, frame int, c int, y int, x int, v double, m int")
    master = stack.master_image(px, ["session"], 12, 12, tiles=4)
    assert {(r.width, r.height) for r in master.select("width", "height").distinct().collect()} == {(11, 12)}
    counts = spark.createDataFrame([(7, 3, 20.0)], "session long, n int, sub double")
    out, done = tmp_path / "master.fit", []
    spark.range(1).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    def write():
        out.write_bytes(bytes(stack.master_files(master, ["session"], counts, "sub").first().content))

    assert live.finish(q, write, lambda: done.append(out.exists()), (60,)) and done == [True]
    head, got = fits.decode(out.read_bytes())
    assert head["cards"]["STACKCNT"] == "3" and head["cards"]["TOTALEXP"] == "60" and got.shape == (3, 12, 11)
    level = lambda p: np.sort([np.median(p[i * 3 : i * 3 + 3, 11 * j // 4 : 11 * (j + 1) // 4]) for i in range(4) for j in range(4)])[3]
    bg = [level(a[c, :, 1:]) for c in range(3)]
    want = np.stack([np.clip(a[c, :, 1:] - (bg[c] - min(bg)), 0, 1) for c in range(3)])
    assert np.allclose(got, want, atol=1e-6)
    mono = stack.master_image(px.where("c = 0"), ["session"], 12, 12)
    assert np.isclose(mono.where("y = 3 AND x = 4").first()["mean"], a[0, 3, 5])  # one channel has nothing to be levelled with
