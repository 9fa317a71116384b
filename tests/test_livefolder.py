"""The live folder as a source: what is read, generations, replays and restarts, and the whole watcher on it."""

import os
import shutil
import time

import pytest

from framelake.sources import store
from framelake.streaming import release
from framelake.streaming.livefolder import LiveFolder, Looks, is_tracked
from framelake.streaming.watch import Policy

from .test_release import rocks, wait  # noqa: F401


def reader(path, log, **more):
    return Looks({"path": str(path), "log": str(log), "quiet": "0", **more})


def rows(r, start):
    end = r.latestOffset()
    return end, [(n, kind) for p in r.partitions(start, end) for _, _, _, n, kind, _, _ in r.read(p)]


@pytest.mark.parametrize("name, yes", [("a.fit", True), ("A.FITS", True), (".a.fit", False), ("a.fit.tmp", False), ("fit", False), ("a.txt", False), ("b.png", True)])
def test_tracked_names(name, yes):
    assert is_tracked(name) == yes and not is_tracked(name, "zz")


def test_content_is_read_only_while_it_is_news(tmp_path, monkeypatch):
    box = tmp_path / "box"
    box.mkdir()
    for k in range(10_000):
        (box / f"s_{k}.fit").write_bytes(b"x")
    opened = []
    real = store.digest
    monkeypatch.setattr(store, "digest", lambda p: opened.append(p) or real(p))
    r = reader(box, tmp_path / "log")
    kinds = []
    at = r.initialOffset()
    for _ in range(3):
        at, seen = rows(r, at)
        kinds.append({k for _, k in seen})
    assert kinds == [{"seen"}, {"read"}, {"read"}] and len(opened) == 20_000
    assert r.latestOffset() == at and len(opened) == 20_000  # nothing new: no batch, and nothing is opened
    (box / "s_7.fit").write_bytes(b"xy")
    (box / "s_8.fit").unlink()
    at, seen = rows(r, at)
    assert sorted(seen) == [("s_7.fit", "seen"), ("s_8.fit", "gone")] and len(opened) == 20_000
    at, seen = rows(r, at)
    assert seen == [("s_7.fit", "read")] and opened[20_000:] == [f"{box}/s_7.fit"]


def test_a_file_that_changes_under_the_reader_is_seen_again(tmp_path, monkeypatch):
    (tmp_path / "a.fit").write_bytes(b"1")
    r = reader(tmp_path, tmp_path / "log")
    was = store.identity(store.stat(str(tmp_path / "a.fit")))
    monkeypatch.setattr(store, "digest", lambda p: (tmp_path / "a.fit").write_bytes(b"22") and "d")
    assert r.content("a.fit", was)[0] == "seen"
    assert r.content("b.fit", was)[0] in ("gone", "seen")


def test_generations(tmp_path):
    box = tmp_path / "box"
    r = reader(box, tmp_path / "log")
    at, seen = rows(r, r.initialOffset())
    assert seen == [] and r.state["generation"] == 0  # a folder that isn't there yet
    box.mkdir()
    (box / "a.fit").write_bytes(b"x")
    at, seen = rows(r, at)
    assert seen == [("a.fit", "seen")] and r.state["generation"] == 0
    shutil.rmtree(box)
    at, seen = rows(r, at)
    assert seen == [("", "gone")] and r.state["generation"] == 1
    box.mkdir()
    (box / "a.fit").write_bytes(b"x")
    at, seen = rows(r, at)
    assert seen == [("a.fit", "seen")] and r.state["generation"] == 1
    other = tmp_path / "other"
    other.mkdir()
    (other / "b.fit").write_bytes(b"x")
    shutil.rmtree(box)
    other.rename(box)  # replaced between two looks
    at, seen = rows(r, at)
    assert seen == [("", "gone"), ("b.fit", "seen")] and r.state["generation"] == 2


def test_replays_and_restarts_see_the_same_looks(tmp_path):
    box, log = tmp_path / "box", tmp_path / "log"
    box.mkdir()
    (box / "a.fit").write_bytes(b"x")
    r = reader(box, log)
    first = r.latestOffset()
    before = [vars(p) for p in r.partitions(r.initialOffset(), first)]
    (box / "b.fit").write_bytes(b"x")
    again = reader(box, log)  # a new driver
    second, seen = rows(again, first)
    assert [vars(p) for p in again.partitions(again.initialOffset(), first)] == before
    assert seen == [("a.fit", "read"), ("b.fit", "seen")]
    again.commit(first)
    assert not os.path.exists(again._file(1)) and os.path.exists(again._file(2))
    with pytest.raises(FileNotFoundError):
        again.partitions({"look": 0}, first)
    third = reader(box, log).latestOffset()
    assert third["look"] == second["look"] + 1  # the first look after a start is a batch, be it empty


def test_the_watcher_on_a_live_folder(rocks, tmp_path):  # noqa: F811
    """Files come out of order, one is rewritten, the query stops and goes on; every revision leaves once, in order."""
    rocks.dataSource.register(LiveFolder)
    box, table = tmp_path / "box", str(tmp_path / "out")
    box.mkdir()
    policy = Policy(quiet=0.1, poll=0.2)

    def start():
        looks = rocks.readStream.format("livefolder").option("path", str(box)).option("log", str(tmp_path / "log")).option("quiet", "0.1").load()
        out = release.release(release.gate(looks, policy), policy)
        return out.writeStream.format("parquet").option("path", table).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="200 milliseconds").start()

    for k in (2, 1):
        (box / f"s_{k}.fit").write_bytes(b"%d" % k)
    q = start()
    assert [r.name for r in sorted(wait(rocks, table, 2), key=lambda r: (r["at"], r.name))] == ["s_1.fit", "s_2.fit"]
    q.stop()
    (box / "s_3.fit").write_bytes(b"3")
    (box / "s_2.fit").write_bytes(b"22")
    q = start()
    got = wait(rocks, table, 4)
    time.sleep(2)
    q.stop()
    assert sorted((r.name, r.effect) for r in wait(rocks, table, 4)) == sorted((r.name, r.effect) for r in got)
    later = [(r.name, r.effect) for r in sorted(got, key=lambda r: r["at"])][2:]
    assert sorted(later) in ([("s_2.fit", "emit"), ("s_3.fit", "emit")], [("s_2.fit", "late"), ("s_3.fit", "emit")])
