"""Relay: nothing unfinished is ever published."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from framelake.sources import store
from framelake.streaming import relay


@pytest.fixture()
def folders(tmp_path):
    src, dst, state = tmp_path / "src", tmp_path / "dst", str(tmp_path / "state")
    src.mkdir()
    return src, dst, state


def effects(df):
    return {r.name: r.effect for r in df.collect()}


def test_first_sighting_waits_and_a_stable_file_is_published(spark, folders):
    src, dst, state = folders
    run = lambda k: effects(relay.tick(spark, k, str(src), str(dst), state, "Light_*_10.0s_*.fit"))
    (src / "Light_old_10.0s_1.fit").write_bytes(b"there before")
    assert run(0) == {}
    (src / "Light_a_10.0s_1.fit").write_bytes(b"abc")
    (src / "Light_a_20.0s_1.fit").write_bytes(b"another exposure")
    assert run(1) == {"Light_a_10.0s_1.fit": "deferred"} and os.listdir(dst) == []
    assert run(2) == {"Light_a_10.0s_1.fit": "relayed"}
    assert os.listdir(dst) == ["Light_a_10.0s_1.fit"] and (dst / "Light_a_10.0s_1.fit").read_bytes() == b"abc"
    assert run(3) == {} and run(3) == {}  # a tick that runs again
    assert len(os.listdir(f"{state}/ticks")) <= 3


def test_without_a_session_what_was_there_is_relayed_too(spark, folders):
    src, dst, state = folders
    (src / "a.fit").write_bytes(b"x")
    assert [effects(relay.tick(spark, k, str(src), str(dst), state, session=False)) for k in (0, 1)] == [{"a.fit": "deferred"}, {"a.fit": "relayed"}]


def test_a_growing_file_is_never_published(spark, folders):
    src, dst, state = folders
    for k in range(4):
        (src / "a.fit").write_bytes(b"x" * (k + 1))
        assert effects(relay.tick(spark, k, str(src), str(dst), state, session=False)) == {"a.fit": "deferred"}
    assert os.listdir(dst) == []
    assert effects(relay.tick(spark, 4, str(src), str(dst), state, session=False)) == {"a.fit": "relayed"}


def test_growth_between_the_tick_and_the_copy_and_during_it(folders, monkeypatch):
    src, dst, _ = folders
    dst.mkdir()
    f = src / "a.fit"
    f.write_bytes(b"abc")
    s = store.stat(str(f))
    threading.Timer(0.1, lambda: f.write_bytes(b"abcd")).start()
    assert relay.copy(str(src), str(dst), "a.fit", s.size, s.mtime_ns, moment=0.4)[0] == "deferred"
    s = store.stat(str(f))
    real = store.chunks
    monkeypatch.setattr(store, "chunks", lambda p: [*real(p), f.write_bytes(b"abcde") and b""])
    assert relay.copy(str(src), str(dst), "a.fit", s.size, s.mtime_ns, 0) == ("retry", "changed during the copy")
    assert os.listdir(dst) == []


def test_a_truncated_copy_is_healed(spark, folders):
    src, dst, state = folders
    dst.mkdir()
    (src / "a.fit").write_bytes(b"whole file")
    (dst / "a.fit").write_bytes(b"whole")
    (src / "b.fit").write_bytes(b"same")
    (dst / "b.fit").write_bytes(b"size")
    got = [effects(relay.tick(spark, k, str(src), str(dst), state, session=False)) for k in range(3)]
    assert got == [{"a.fit": "deferred"}, {"a.fit": "healed"}, {}] and (dst / "a.fit").read_bytes() == b"whole file" and (dst / "b.fit").read_bytes() == b"size"


def test_a_failed_copy_leaves_nothing_that_shows_and_is_tried_again(spark, folders, monkeypatch):
    src, dst, _ = folders
    dst.mkdir()
    (src / "a.fit").write_bytes(b"abc")
    s = store.stat(str(src / "a.fit"))

    def broken(path):
        yield b"a"
        raise OSError("the network went")

    with monkeypatch.context() as m:
        m.setattr(store, "chunks", broken)
        assert relay.copy(str(src), str(dst), "a.fit", s.size, s.mtime_ns, 0) == ("retry", "the network went")
        assert os.listdir(dst) == []
        m.setattr(store, "remove", lambda p: None)  # the task dies before it tidies up
        relay.copy(str(src), str(dst), "a.fit", s.size, s.mtime_ns, 0)
    left = os.listdir(dst)
    assert len(left) == 1 and left[0].startswith(".") and left[0].endswith(".relaytmp")
    assert relay.names_of(spark, str(dst), "*").count() == 0
    assert relay.copy(str(src), str(dst), "a.fit", s.size, s.mtime_ns, 0) == ("relayed", None)


def test_due_is_a_join(spark):
    rows = lambda *r: spark.createDataFrame(list(r), relay.LISTING)
    now = rows(("new", 1, 1), ("grown", 2, 2), ("done", 3, 3), ("cut", 4, 4), ("old", 5, 5), ("touched", 6, 7))
    before = rows(("grown", 1, 1), ("done", 3, 3), ("cut", 4, 4), ("old", 5, 5), ("touched", 6, 6))
    out = relay.due(now, before, rows(("done", 3, 9), ("cut", 2, 9)), rows(("old", 5, 5)))
    assert {r.name: r.action for r in out.collect()} == {"new": "defer", "grown": "defer", "cut": "heal", "touched": "defer"}
    assert {r.name for r in relay.due(now, None, now.limit(0)).where(F.col("action") != "defer").collect()} == set()


def test_a_source_that_is_not_there_gives_no_tick(spark, tmp_path):
    assert relay.tick(spark, 0, str(tmp_path / "none"), str(tmp_path / "dst"), str(tmp_path / "state")) is None


def test_relay_as_a_stream(spark, folders):
    src, dst, state = folders
    q = relay.relay(spark, str(src), str(dst), state, "*.fit", poll=0.3)
    end = time.time() + 90
    while not os.path.exists(f"{state}/outcomes/tick=0") and time.time() < end:
        time.sleep(0.2)
    for k in range(5):
        (src / f"{k}.fit").write_bytes(b"x" * 1000 * k)
    while (not dst.exists() or len([n for n in os.listdir(dst) if not n.startswith(".")]) < 5) and time.time() < end and q.isActive:
        time.sleep(0.2)
    q.stop()
    assert sorted(n for n in os.listdir(dst) if not n.startswith(".")) == [f"{k}.fit" for k in range(5)]
    assert all((dst / f"{k}.fit").stat().st_size == 1000 * k for k in range(5))
