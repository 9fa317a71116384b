"""Device folders, north-up rasters, manifests and denoised files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import devices, filters, planes
from framelake.sources import fits, session_files, store

SHAPE = "volume string, parent string, name string, mtime long"


@pytest.mark.parametrize("name, yes", [("EMMC Images", True), ("EMMC Images-12", True), ("emmc images-x", False), ("My Seestar S50", True), ("Seestar backup", False), ("EMMC Images clone", False), ("T7", False)])
def test_works_volumes(spark, name, yes):
    assert spark.range(1).select(devices.is_works_volume(F.lit(name))).first()[0] == yes


def test_newest_works_folder_with_target_and_exposure(spark):
    folders = spark.createDataFrame([("Seestar", "MyWorks", "M 31_sub", 5), ("Seestar", "MyWorks", "M 42_sub", 9), ("Seestar", "MyWorks", "M 45", 99), ("Seestar", "Other", "M 1_sub", 99), ("Seestar archive", "MyWorks", "M 2_sub", 99)], SHAPE)
    files = spark.createDataFrame([("Seestar", "MyWorks/M 42_sub", n, t) for t, n in ((9, "Light_M 42_30.0s_LP_20260710-235959.fit"), (1, "Light_M 42_20.0s_LP_20260711-013530.fit"), (99, "Light_M 42_10.0s_LP_20260712-000000.jpg"), (98, "odd.fit"))], SHAPE)
    got = devices.works_folder(folders, files).collect()
    assert [tuple(r) for r in got] == [("Seestar", "MyWorks/M 42_sub", "M 42", 20.0)]  # the latest stamp, not the latest file
    assert devices.works_folder(folders, files.where("false")).first().exposure is None
    assert devices.works_folder(folders.where("volume = 'none'"), files).count() == 0


def test_newest_lights_folder_with_files_and_header(spark, tmp_path):
    for target, object_ in (("M 8", "old"), ("M 16", "new")):
        p = tmp_path / "T7" / "Autorun" / "Light" / target
        p.mkdir(parents=True)
        (p / f"{object_}.FITS").write_bytes(fits.encode(np.zeros((1, 2, 2), np.float32), extra={"EXPTIME": "300.0"}))
    folders = spark.createDataFrame([("T7", "Autorun/Light", "M 8", 5), ("T7", "Autorun/Light", "M 16", 7), ("T7", "Autorun/Light", "empty", 9), ("T7 Backup", "Autorun/Light", "M 3", 99)], SHAPE)
    files = spark.createDataFrame([("T7", "Autorun/Light/M 8", "old.FITS", 1), ("T7", "Autorun/Light/M 16", "new.FITS", 1), ("T7", "Autorun/Light/empty", "a.txt", 1), ("T7 Backup", "Autorun/Light/M 3", "a.fit", 1)], SHAPE)
    root = tmp_path.as_posix()
    told = fits.newest_metadata(spark, root).select(F.lit("T7").alias("volume"), F.regexp_replace("folder", f"^.*{root}/T7/", "").alias("folder"), "exposure_seconds", "extension")
    assert [tuple(r) for r in devices.lights_folder(folders, files, told).collect()] == [("T7", "Autorun/Light/M 16", "M 16", 300.0, "fits")]
    assert tuple(devices.lights_folder(folders, files).first())[3:] == (None, "fit")


@pytest.mark.parametrize("degrees", [0.0, 7.0, -12.0, 90.0, 200.0])
def test_a_turned_frame_has_its_stars_where_the_sky_has_them(spark, degrees):
    """The frame shows the north-up grid at R(-degrees); turned, every star is back at its place, times the zoom."""
    h, w, t = 90, 120, np.radians(degrees)
    stars = np.array([(-20.0, 5.0), (15.0, -18.0), (4.0, 22.0)])
    c, s = np.cos(t), np.sin(t)
    at = stars @ np.array([[c, s], [-s, c]]).T + [w / 2, h / 2]
    y, x = np.mgrid[0:h, 0:w] + 0.5
    a = sum(np.exp(-((x - u) ** 2 + (y - v) ** 2) / 8) for u, v in at)
    df = spark.createDataFrame([(1, w, h, [a.ravel().tolist()] * 3, degrees), (2, w, h, [a.ravel().tolist()], None)], "frame int, width int, height int, pixels array<array<double>>, turn double")
    got = {r.frame: r for r in planes.turn_north_up(df, ["frame"], "turn").collect()}
    assert got[2].pixels == [a.ravel().tolist()] and (got[2].width, got[2].height) == (w, h)
    r = got[1]
    small = abs((degrees + 180) % 360 - 180) <= 15
    assert ((r.width, r.height) == (w, h)) == small
    zoom = abs(c) + max(w / h, h / w) * abs(s) if small else 1.0
    b = np.array(r.pixels).reshape(3, r.height, r.width)
    assert np.array_equal(b[0], b[2])
    yy, xx = np.mgrid[0 : r.height, 0 : r.width] + 0.5
    for u, v in stars * zoom + [r.width / 2, r.height / 2]:
        near = (xx - u) ** 2 + (yy - v) ** 2 < 36
        m = b[0] * near
        assert abs((m * xx).sum() / m.sum() - u) < 0.15 and abs((m * yy).sum() / m.sum() - v) < 0.15
    if degrees == 0:
        assert np.allclose(b[0], a)
    if small:
        ones = planes.turned(np.ones((1, h, w)), degrees, w, h, zoom)
        assert ones.min() > 0.999  # no empty corner
    else:
        assert planes.turned(np.ones((1, h, w)), degrees, r.width, r.height, 1.0).min() == (1.0 if degrees % 90 == 0 else 0.0)


def test_manifests_are_replaced_one_by_one(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    old = spark.createDataFrame([("a", "M31"), ("b", "M42")], "session_id string, target string")
    assert {r.session_id for r in session_files.persist(old, root).collect()} == {"a", "b"}
    session_files.persist(old.where("session_id = 'b'").withColumn("target", F.lit("M45")), root).collect()
    read = lambda s: json.loads((tmp_path / s / "session.json").read_text())["target"]
    assert (read("a"), read("b")) == ("M31", "M45") and sorted(p.name for p in (tmp_path / "b").iterdir()) == ["session.json"]
    real = store.at

    def broken(path):
        fs, p = real(path)

        class Half:
            def __getattr__(self, name):
                if name == "move":
                    raise OSError("died before the rename")
                return getattr(fs, name)

        return Half(), p

    monkeypatch.setattr(store, "at", broken)
    with pytest.raises(OSError):
        store.write(f"{root}/a/session.json", b"{}")
    assert read("a") == "M31"


def test_denoised_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    a = (0.2 + 0.02 * rng.standard_normal((3, 70, 80))).astype(np.float32)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "master.fit").write_bytes(fits.encode(a, 12, 240.0, {"OBJECT": "M31"}))
    (tmp_path / "in" / "cut.fit").write_bytes(b"cut")
    got = {r.path.rsplit("/", 1)[1]: r for r in fits.denoise_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), 0.5).collect()}
    assert got["cut.fit"].error and got["cut.fit"].written is None and got["master.fit"].error is None
    h, b = fits.decode((tmp_path / "out" / "master.fit").read_bytes(), clamp=False)
    assert (h["cards"]["STACKCNT"], h["cards"]["TOTALEXP"], h["cards"]["OBJECT"]) == ("12", "240", "M31")
    one = spark.createDataFrame([(0, 80, 70, True, [p.ravel().astype(float).tolist() for p in a])], "k int, width int, height int, linear boolean, pixels array<array<double>>")
    assert np.allclose(b, np.array(filters.denoise(one, ["k"], 0.5).first().pixels).reshape(b.shape), atol=1e-6) and b.std() < a.std() * 0.95


def test_linear_reads_keep_what_lies_outside_the_range():
    a = np.array([[[-0.5, 0.25], [1.5, 0.0]]], np.float32)
    assert np.array_equal(fits.decode(fits.encode(a), clamp=False)[1], a) and fits.decode(fits.encode(a))[1].max() == 1.0
