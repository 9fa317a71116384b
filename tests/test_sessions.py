"""Streamed stacks against batch ones, alerts by timer, and draining by progress."""

import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import stack
from framelake.streaming import sessions
from framelake.streaming.sessions import Alerts, Clock, Progress, Stack, StillRunning, Windows, admit

from .test_release import rocks, wait  # noqa: F401

FRAMES = "session string, ord long, stars int, width int, height int, channels int, matched boolean, weight double, planes array<array<double>>"


def frames_of(seed, n=120):
    r, rng = random.Random(seed), np.random.default_rng(seed)
    out = []
    for k in range(n):
        s = r.choice("aab")
        w = 3 if r.random() < 0.95 else 4
        plane = rng.random(w * 2)
        plane[r.random() < 0.2] = float("nan") if r.random() < 0.5 else plane[0]
        out.append((s, k, r.choice([30, 30, 16, 5, 2]), w, 2, 1, r.random() < 0.25, r.uniform(0.25, 4), [plane.tolist()]))
    return out


def plain(rows, after):
    """Stacks by a loop: (session, epoch) -> sums; and each frame's outcome."""
    state, told, sums = {}, {}, {}
    for s, k, stars, w, h, c, matched, weight, planes in rows:
        t = state.setdefault(s, {"epoch": 0, "run": 0, "ref": None})
        epoch = t["epoch"]
        if t["ref"] is None:
            outcome = "seed" if stars >= 15 else "few_seed_stars"
            if outcome == "seed":
                t["ref"] = (w, h)
        elif (w, h) != t["ref"]:
            outcome = "size_mismatch"
        elif stars < 3:
            outcome = "few_stars"
        elif matched:
            outcome = "stacked"
        else:
            outcome = "no_transform"
            t["run"] += 1
            if t["run"] == after:
                t.update(epoch=epoch + 1, run=0, ref=None)
        told[k] = (outcome, epoch)
        if outcome in ("seed", "stacked"):
            t["run"] = 0
            for i, v in enumerate(planes[0]):
                if np.isfinite(v):
                    a = sums.setdefault((s, epoch, 0, i // w, i % w), [0.0, 0.0, 0])
                    a[0], a[1], a[2] = a[0] + weight, a[1] + weight * v, a[2] + 1
    return told, {k: (wv / w, n) for k, (w, wv, n) in sums.items()}


@pytest.mark.parametrize("seed", range(3))
def test_streamed_stack_equals_a_loop_over_random_triggers(rocks, tmp_path, seed):  # noqa: F811
    rows, r = frames_of(seed), random.Random(seed)
    src, out, check = (str(tmp_path / x) for x in ("in", "stack", "check"))
    told, want = plain(rows, 3)
    assert max(e for _, e in told.values()) >= 1

    def run():
        df = rocks.readStream.schema(FRAMES).parquet(src)
        q = sessions.epochs(df, after=3).writeStream.foreachBatch(sessions.stack_sink(out)).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(300)

    at = 0
    while at < len(rows):  # every trigger takes some frames; the query starts anew each time
        n = r.randint(20, 60)
        rocks.createDataFrame(rows[at : at + n], FRAMES).coalesce(1).write.mode("append").parquet(src)
        at += n
        run()
    got = {(x.session, x.epoch, x.c, x.y, x.x): (x["mean"], x.coverage) for x in sessions.read_stack(rocks, out).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    assert len(sessions.versions(out)) <= 2
    newest = sessions.versions(out)[-1]
    again = rocks.createDataFrame(rows[-1:], FRAMES).withColumns({"epoch": F.lit(99).cast("long"), "outcome": F.lit("seed")})
    for _ in range(2):  # a batch that runs again adds nothing twice
        sessions.stack_sink(out)(again, newest + 1)
        assert sessions.read_stack(rocks, out).where("epoch = 99").agg(F.max("coverage")).first()[0] == 1


def test_epochs_in_batch_agree_with_admission_and_reseeds(rocks):  # noqa: F811
    rows = frames_of(9, 80)
    df = rocks.createDataFrame(rows, FRAMES)
    got = {r.ord: (r.outcome, r.epoch) for r in sessions.epochs(df, after=3).collect()}
    assert got == plain(rows, 3)[0]
    never = sessions.epochs(df.withColumn("matched", F.lit(True)), after=3).select("ord", "outcome")
    batch = stack.admission(df, "session", "ord").select("ord", "outcome")
    assert {tuple(r) for r in never.collect()} == {tuple(r) for r in batch.collect()}


def test_counts_go_on_over_reseeds():
    s = Stack()
    for matched in [True] * 3 + [False] * 6 + [True] * 2:
        s, *_ = admit(s, 30, 4, 4, 1, matched)
    assert (s.epoch, s.accepted, s.rejected, s.run, s.width) == (1, 5, 6, 0, 4)
    assert admit(Stack(), 30, 1, 4, 1, True)[1] == "too_small" and admit(Stack(width=4, height=4, channels=3), 30, 4, 4, 1, True)[1] == "channel_mismatch"


# ---- alerts


def test_alerts_fire_once_an_episode_and_the_planned_stop_comes_first():
    a = Alerts(idle_minutes=10)
    c = a.tell(Clock(), "start", 0.0, False, None, 700.0)
    c = a.tell(c, "frame", 100.0, True, 20.0, None)
    assert a.fire(c, 190.0) == (c, [])  # exactly at the threshold is no stall
    c, out = a.fire(c, 190.5)
    assert out == [("stalled", 90.5)] and a.fire(c, 600.0)[1] == []
    assert a.next(c) == (700.0, "end_session")
    c, out = a.fire(c, 700.0)
    assert out == [("end_session", 0.0)]
    c, out = a.fire(c, 701.0)
    assert out == [("safeguard", 601.0)] and a.fire(c, 1e6)[1] == [] and a.next(c) is None
    c = a.tell(c, "frame", 800.0, False, None, None)  # a rejected frame ends the stall but doesn't arm the safeguard
    assert a.next(c)[1] == "stalled" and a.next(c)[0] > 890.0
    c = a.tell(c, "frame", 900.0, True, 60.0, None)
    assert a.fire(c, 1080.0)[1] == [] and a.fire(c, 1080.1)[1] == [("stalled", pytest.approx(180.1))]
    assert Alerts().next(Clock()) is None


def test_timers_alert_without_a_later_row(rocks, tmp_path):  # noqa: F811
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = time.time()
    rows = [("a", t, "start", None, None, t + 6.0), ("a", t, "frame", True, 0.1, None), ("b", t, "frame", True, 0.1, None), ("c", t, "frame", False, 0.1, None)]
    rocks.createDataFrame(rows, sessions.TICKS).coalesce(1).write.parquet(src)
    alerts = Alerts(least=3.0, idle_minutes=0.1, retry=0.5)
    q = sessions.watchdog(rocks.readStream.schema(sessions.TICKS).parquet(src), alerts).writeStream.format("parquet").option("path", out)
    q = q.option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    end, got = time.time() + 90, []
    while len(got) < 6 and time.time() < end:
        time.sleep(0.3)
        try:
            got = rocks.read.schema(sessions.ALERTS).parquet(out).collect()
        except Exception:  # not written yet
            pass
    time.sleep(1.5)
    q.stop()
    got = sorted(rocks.read.schema(sessions.ALERTS).parquet(out).collect(), key=lambda r: r["at"])
    by = {s: [r.action for r in got if r.session == s] for s in "abc"}
    assert by == {"a": ["stalled", "end_session", "safeguard"], "b": ["stalled", "safeguard"], "c": ["stalled"]}


# ---- progress and draining


class Fake:
    """A query by script: seconds at which it makes progress, ends, and whether it reads and stops."""

    def __init__(self, progress=(), ends=None, reads=(), stops=True):
        self.now, self.progress, self.ends, self.reads, self.stops, self.isActive = 0.0, progress, ends, reads, stops, True

    def awaitTermination(self, seconds):
        if self.ends is not None and self.ends <= self.now + seconds:
            return True
        self.now += seconds
        return False

    @property
    def status(self):
        return {"isTriggerActive": any(a <= self.now < b for a, b in self.reads)}

    def stop(self):
        self.isActive = not self.stops

    def seen(self):
        return sum(p <= self.now for p in self.progress)


@pytest.mark.parametrize(
    "fake, ended, at",
    [
        (Fake(ends=50), True, 0),
        (Fake(progress=[100 * k for k in range(1, 20)], ends=2000), True, None),  # as long as it gets on
        (Fake(), False, 120),  # nothing and no read under way
        (Fake(reads=[(0, 1e9)]), False, 120 + 5 * 60),  # a dead read gets five windows, not five times both
        (Fake(reads=[(0, 1e9)], progress=[350], ends=700), True, None),  # a slow one goes on
        (Fake(reads=[(0, 200)]), False, 240),  # the read ends without progress
    ],
)
def test_drain_windows(fake, ended, at):
    assert sessions.drain(fake, Windows(), fake.seen) is ended
    assert at is None or fake.now == at


def test_a_query_that_does_not_stop_is_not_committed():
    with pytest.raises(StillRunning):
        sessions.drain(Fake(stops=False), Windows(stop=0.1), lambda: 0)


def test_progress_counts_frames_and_drains_a_real_import(spark, tmp_path):
    src, progress = str(tmp_path / "in"), Progress()
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(src)
    spark.streams.addListener(progress)
    try:
        df = sessions.counted(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src), F.col("id") % 3 == 0)
        q = df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert sessions.drain(q, Windows(quiet=30.0), lambda: progress.of(q.id))
        end = time.time() + 30
        while progress.of(q.id)[0] < 30 and time.time() < end:
            time.sleep(0.1)
        assert progress.of(q.id) == (30, 10, 20)
        slow = spark.readStream.schema("id long").parquet(src).writeStream.foreachBatch(lambda d, b: threading.Event().wait(30)).trigger(availableNow=True).start()
        began = time.time()
        assert not sessions.drain(slow, Windows(0.5, 0.5, 2, 20.0)) and time.time() - began < 25 and not slow.isActive
    finally:
        spark.streams.removeListener(progress)
