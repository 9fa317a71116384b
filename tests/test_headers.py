"""Headers by range, the newest readable file of each folder, and filters that keep files closed."""

import os
import time

import numpy as np
import pytest

from framelake.sources import fits, store


@pytest.fixture()
def opened(monkeypatch):
    """Sizes and paths of all reads of heads; only for calls in this process."""
    out = []
    real = store.head
    monkeypatch.setattr(store, "head", lambda p, n: out.append(p) or real(p, n))
    return out


def large(path, **cards):
    path.write_bytes(fits.encode(np.zeros((1, 300, 400), np.float32), 3, 60.0, cards))


def test_heads_are_ranges(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10)
    assert store.head(str(tmp_path / "a"), 4) == b"xxxx" and store.head(f"file:{tmp_path}/a", 100) == b"x" * 10
    assert store.opens(f"file:///{tmp_path}") and not store.opens("viewfs://store/in")


def test_frames_read_heads_and_list_without_content(spark, tmp_path):
    large(tmp_path / "a.fits", OBJECT="M31")
    (tmp_path / "b.fit").write_bytes(b"cut")
    df = fits.frames(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan
    got = {r.path.rsplit("/", 1)[1]: r for r in df.collect()}
    assert (got["a.fits"].width, got["a.fits"].header["OBJECT"], got["a.fits"].error) == (400, "M31", None) and got["b.fit"].error


def test_frames_of_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    large(tmp_path / "a.fits", OBJECT="M31")
    monkeypatch.setattr(store, "opens", lambda path: False)
    assert fits.frames(spark, str(tmp_path)).first().header["OBJECT"] == "M31"
    assert [r.object for r in fits.newest_metadata(spark, str(tmp_path)).collect()] == ["M31"]


def test_newest_readable_file_of_each_folder(spark, tmp_path):
    t = time.time() - 1000
    for k, (name, content) in enumerate(
        [("x/old.fit", "NGC1"), ("x/new.FITS", "NGC2"), ("x/cut.fit", None), ("x/empty.fit", b""), ("y/one.fts", "M1"), ("z/bad.fit", None), ("y/later.txt", b"no")]
    ):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        if isinstance(content, str):
            p.write_bytes(fits.encode(np.zeros((1, 2, 2), np.float32), extra={"OBJECT": content, "EXPTIME": "30.0"}))
        else:
            p.write_bytes(b"SIMPLE  = T" if content is None else content)
        os.utime(p, (t + k, t + k))
    got = {r.folder.rsplit("/", 1)[1]: (r.name, r.extension, r.object, r.exposure_seconds) for r in fits.newest_metadata(spark, str(tmp_path)).collect()}
    assert got == {"x": ("new.FITS", "fits", "NGC2", 30.0), "y": ("one.fts", "fts", "M1", 30.0)}
    assert fits.newest_metadata(spark, str(tmp_path / "z")).count() == 0


def test_a_readable_newest_file_is_the_only_one_opened(tmp_path, opened):
    """One round of the probe on listings of 500 files, run here instead of in a worker."""
    for k in range(500):
        (tmp_path / f"{k}.fit").write_bytes(b"cut")
    large(tmp_path / "z.fit")
    import pandas as pd

    newest = max(store.listing(str(tmp_path)), key=lambda f: (f.mtime_ns, f.base_name))
    rows = next(fits._parsed([pd.DataFrame({"folder": ["f"], "path": [newest.path], "name": ["z.fit"], "modificationTime": [pd.Timestamp(0)], "head": [store.head(newest.path, fits.HEAD)]})]))
    assert rows["header"][0]["NAXIS1"] == "400" and len(opened) == 1


def test_filters_on_path_keep_files_closed(spark, tmp_path):
    for n in ("a.fit", "b.fit", "sub/c.fit"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        large(tmp_path / n)
    spark.dataSource.register(fits.FitsDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("fits").option("filters", "true").load(str(tmp_path))
        names = lambda d: sorted(r.path.rsplit("/", 1)[1] for r in d.collect())
        assert names(df) == ["a.fit", "b.fit", "c.fit"]
        assert names(df.where(df.path.endswith("b.fit"))) == ["b.fit"] and names(df.where(df.path.contains("/sub/") & (df.width == 400))) == ["c.fit"]
        assert names(df.where(df.path.isin(f"{tmp_path}/a.fit", f"{tmp_path}/b.fit"))) == ["a.fit", "b.fit"] and names(df.where(df.width < 5)) == []
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    r = fits._Choosy(str(tmp_path), fits.HEAD, 8)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    width = GreaterThan(("width",), 3)
    assert list(r.pushFilters([StringEndsWith(("path",), "b.fit"), width, EqualTo(("height",), 3)]))[0] is width
    assert [p.paths for p in r.partitions()] == [[f"{tmp_path}/b.fit"]]
