import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import config, demo, fits, session_files, star_catalog


def card(key, value):
    return f"{key:<8}= {value}".ljust(80)


def file_of(cards, body=b""):
    head = "".join(cards) + "END".ljust(80)
    return head.ljust(-(-len(head) // 2880) * 2880).encode() + body


def test_card_values():
    assert fits.card_value("'O''HARA' / who") == "O'HARA"
    assert fits.card_value("  12.5 / seconds") == "12.5"
    assert fits.card_value("'a / b   '") == "a / b"
    assert fits.number({"A": "1.5D3"}, "A", 0) == 1500.0 and fits.number({}, "A", 7) == 7
    with pytest.raises(fits.FitsError):
        fits.number({"A": "x1"}, "A", 0)


@pytest.mark.parametrize("change", [{"NAXIS": "4"}, {"NAXIS1": "0"}, {"BITPIX": "12"}, {"NAXIS1": "200000"}])
def test_bad_headers(change):
    cards = {"BITPIX": "-32", "NAXIS": "2", "NAXIS1": "4", "NAXIS2": "4"} | change
    with pytest.raises(fits.FitsError):
        fits.read_header(file_of([card(k, v) for k, v in cards.items()]))


def test_round_trip_and_scaling(spark, tmp_path):
    ramp = (np.arange(16, dtype=np.float32) / 15).reshape(1, 4, 4)
    (tmp_path / "a.fits").write_bytes(fits.encode(ramp, 3, 60.0, {"OBJECT": "M31", "DATE-OBS": "2024-01-02T03:04:05.5"}))
    raw = np.array([[0, 1], [2, 3]]) * 8192 - 32768
    low = file_of([card("BITPIX", "16"), card("NAXIS", "2"), card("NAXIS1", "2"), card("NAXIS2", "2"), card("BZERO", "32768"), card("XPIXSZ", "3.76"), card("FILTER", "'  '")], raw.astype(">i2").tobytes())
    (tmp_path / "b.fit").write_bytes(low)
    (tmp_path / "c.fit").write_bytes(b"nothing here")
    f = {r.path.rsplit("/", 1)[1]: r for r in fits.frames(spark, str(tmp_path)).collect()}
    assert f["a.fits"].width == 4 and not f["a.fits"].bottom_up and f["b.fit"].bottom_up and f["c.fit"].error
    rows = fits.pixel_rows(spark, str(tmp_path))
    got = fits.pixels(rows).where("path like '%b.fit'").orderBy("y", "x").collect()
    assert [round(r.v * 65535) for r in got] == [2 * 8192, 3 * 8192, 0, 8192]
    again = fits.write_frames(rows.where("path like '%a.fits'"), ["path"]).first().content
    assert np.array_equal(fits.decode(bytes(again))[1], ramp)
    told = rows.where("path like '%a.fits'").withColumns({"n": F.lit(3), "e": F.lit(60.0), "more": F.create_map(F.lit("OBJECT"), F.lit("it's M31"))})
    cards = fits.read_header(bytes(fits.write_frames(told, ["path"], "n", "e", "more").first().content))["cards"]
    assert (cards["STACKCNT"], cards["TOTALEXP"], cards["OBJECT"]) == ("3", "60", "it's M31")
    meta = fits.frames(spark, str(tmp_path)).where("error is null").select("path", fits.metadata(F.col("header")).alias("m"), fits.observed_at(fits.metadata(F.col("header"))["date_obs"], F.col("mtime")).alias("t"))
    m = {r.path.rsplit("/", 1)[1]: r for r in meta.collect()}
    assert m["a.fits"].m.object == "M31" and m["a.fits"].t == datetime.datetime(2024, 1, 2, 3, 4, 5, 500000)
    assert m["b.fit"].m.pixel_size_um == 3.76 and m["b.fit"].m.filter is None
    spark.dataSource.register(fits.FitsDataSource)
    assert spark.read.format("fits").load(str(tmp_path)).count() == 2
    with pytest.raises(fits.FitsError):
        fits.decode(low[:-3])


def test_every_extension_in_either_case(spark, tmp_path):
    data = fits.encode(np.zeros((1, 2, 2), np.float32))
    names = [f"{i}.{e}" for i, e in enumerate(("fit", "fits", "fts", "FIT", "FITS", "Fts"))]
    for n in [*names, "x.txt", "y.fitsx", "z.png"]:
        (tmp_path / n).write_bytes(data)
    listed = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").distinct().collect())
    spark.dataSource.register(fits.FitsDataSource)
    assert listed(fits.frames(spark, str(tmp_path))) == listed(fits.pixel_rows(spark, str(tmp_path))) == listed(spark.read.format("fits").load(str(tmp_path))) == sorted(names)


def test_star_catalog(spark, tmp_path):
    stars = np.array([[10.0, 5.0, 7.0], [20.0, -5.0, 8.0]])
    (tmp_path / "cat.bin").write_bytes(star_catalog.encode(stars))
    got = star_catalog.read(spark, str(tmp_path / "cat.bin"))
    assert [tuple(r) for r in got.orderBy("dec").collect()] == [(20.0, -5.0, 8.0), (10.0, 5.0, 7.0)]
    star_catalog.write(got, str(tmp_path / "cat"), 1)
    assert spark.read.parquet(str(tmp_path / "cat")).count() == 2
    with pytest.raises(ValueError):
        star_catalog.decode(b"LASC" + b"\0" * 4)


def test_session_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"session_id": "s", "target": "M|31", "sub_exposure_seconds": 20, "snapshots": [{"index": 1, "source_file": "a,b.fit", "mean": 0.5}]}')
    m = session_files.read_manifests(spark, str(tmp_path / "m.json"))
    assert m.first().master_outcome is None
    lines = {r["index"]: r.line for r in session_files.frame_csv(session_files.snapshots(m)).collect()}
    assert lines == {0: ",".join(session_files.CSV_COLUMNS), 1: '1,,"a,b.fit",,,20.0,,,0.5,,'} and len(session_files.CSV_COLUMNS) == 11
    text = session_files.summary_markdown(m.withColumns({"stack_frame_count": F.lit(6), "started_at": F.lit("2024-01-02 03:04:05.25").cast("timestamp")})).first().markdown
    assert [x for x in text.split("\n") if x.startswith("#")] == ["# Session Summary", "## Session", "## Equipment and site", "## Final stack", "## Files to inspect"]
    for line in ("| Target | M\\|31 |", "| Started | 2024-01-02T03:04:05.250Z |", "| Ended | — |", "| Mount | — |", "| Current-stack integration | 2m · 6 × 20s |", "| Master expected | unknown |", "| Session accepted | 1 |"):
        assert line in text
    assert "Notes" not in text and text.endswith("\n")
    session_files.write_manifests(m, str(tmp_path / "out"))
    assert session_files.read_manifests(spark, str(tmp_path / "out")).first().target == "M|31"
    assert '"session_id"' in session_files.manifest_json(m).first().json


def test_messages(spark):
    df = spark.createDataFrame([('{"active": true, "skipped": 3, "total": 10}',), ("nonsense",)], "j string")
    got = [r[0] for r in df.select(config.health(F.col("j"))).collect()]
    assert got[0].skipped == 3 and got[0].duration is None and (got[1] is None or got[1].active is None)
    import base64
    import hashlib

    once = base64.b64encode(hashlib.sha256(b"pwsalt").digest())
    want = base64.b64encode(hashlib.sha256(once + b"ch").digest()).decode()
    r = spark.range(1).select(config.auth_response(F.lit("pw"), F.lit("salt"), F.lit("ch"))).first()[0]
    assert r == want


def test_synthetic_frames(spark):
    state, want = demo.SEED, []
    for _ in range(200):
        state = (state * demo.FACTOR + demo.STEP) % 2**64
        want.append((state >> 33) / (2**32 - 1))
    assert demo.draws(0, 200).tolist() == want and demo.draws(150, 50).tolist() == want[150:] and len(demo.draws(5, 0)) == 0
    out = {r.k: r.content for r in demo.frames(spark, 3, 40, 30, 5).collect()}
    shots = {k: fits.decode(bytes(c))[1][0] for k, c in out.items()}
    assert sorted(shots) == [1, 2, 3] and all(np.array_equal(shots[k], demo.frame(k, 3, 40, 30, 5)) for k in shots)
    assert np.median(shots[3]) <= np.median(shots[1]) + 0.05 and shots[3].max() > shots[1].max() * 0.9
    with pytest.raises(fits.FitsError):
        fits.decode(bytes(out[1])[: len(out[1]) // 2])
