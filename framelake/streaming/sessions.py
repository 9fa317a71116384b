"""Live sessions: epochs of a stack and the stack itself, alerts by timer, and draining by progress."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from framelake.operators.stack import MIN_MATCH_STARS, MIN_SEED_STARS, RESEED_AFTER
from framelake.sources import store

# ---- the stack as one stateful stream


@dataclass(frozen=True)
class Stack:
    """A session's reference and what happened so far; counts go on over reseeds."""

    epoch: int = 0
    run: int = 0
    width: int | None = None
    height: int | None = None
    channels: int | None = None
    accepted: int = 0
    rejected: int = 0


def admit(s: Stack, stars: int, width: int, height: int, channels: int, matched: bool, after: int = RESEED_AFTER) -> tuple[Stack, str, int]:
    """The next state, the frame's outcome (as stack.admission, and no_transform) and the epoch it belongs to.

    Without a reference a frame with enough stars becomes it. Frames that can't be matched
    add to a run, which an accepted frame ends; a run of ``after`` clears the reference and
    begins an epoch. Frames of another size or with few stars neither add to it nor end it.
    """
    epoch = s.epoch
    if width < 2 or height < 2:
        outcome = "too_small"
    elif s.width is None:
        outcome = "seed" if stars >= MIN_SEED_STARS else "few_seed_stars"
    elif (width, height) != (s.width, s.height):
        outcome = "size_mismatch"
    elif channels != s.channels:
        outcome = "channel_mismatch"
    elif stars < MIN_MATCH_STARS:
        outcome = "few_stars"
    else:
        outcome = "stacked" if matched else "no_transform"
    if outcome == "seed":
        s = replace(s, width=width, height=height, channels=channels)
    if outcome in ("seed", "stacked"):
        return replace(s, run=0, accepted=s.accepted + 1), outcome, epoch
    s = replace(s, rejected=s.rejected + 1, run=s.run + (outcome == "no_transform"))
    if outcome == "no_transform" and after and s.run >= after:
        s = replace(s, epoch=epoch + 1, run=0, width=None, height=None, channels=None)
    return s, outcome, epoch


class Epochs(StatefulProcessor):
    def __init__(self, columns: list[str], after: int):
        self.columns, self.after = columns, after

    def init(self, handle) -> None:
        self.state = handle.getValueState("stack", "epoch long, run long, width long, height long, channels long, accepted long, rejected long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = Stack(*self.state.get()) if self.state.exists() else Stack()
        pdf = pd.concat(list(rows)).sort_values("ord", kind="stable")
        added = []
        for r in pdf[["stars", "width", "height", "channels", "matched"]].itertuples(index=False):
            s, outcome, epoch = admit(s, int(r.stars), int(r.width), int(r.height), int(r.channels), bool(r.matched), self.after)
            added.append((epoch, outcome, s.accepted, s.rejected))
        self.state.update(astuple(s))
        yield pdf[self.columns].assign(**{c: [a[k] for a in added] for k, c in enumerate(("epoch", "outcome", "accepted", "rejected"))})

    def close(self) -> None:
        pass


def epochs(frames: DataFrame, after: int = RESEED_AFTER) -> DataFrame:
    """frames (session, ord, stars, width, height, channels, matched and more) with epoch, outcome and the session's counts.

    State is one session's reference, run and counts. Frames of a batch are taken in order of
    ord; later batches come later. Needs the RocksDB state store, as release does.
    """
    added = [T.StructField(n, t) for n, t in (("epoch", T.LongType()), ("outcome", T.StringType()), ("accepted", T.LongType()), ("rejected", T.LongType()))]
    return frames.groupBy("session").transformWithStateInPandas(Epochs(frames.columns, after), T.StructType([*frames.schema.fields, *added]), "append", "none")


STACK_KEYS = ["session", "epoch", "c", "y", "x"]


def partial_stack(frames: DataFrame) -> DataFrame:
    """Sums of the accepted among epochs' frames with planes (array of channels of pixels) and weight: STACK_KEYS, w, wv, coverage.

    Pixels that are null or not finite are not covered.
    """
    p = frames.where("outcome IN ('seed', 'stacked')").select("session", "epoch", "width", "weight", F.posexplode("planes").alias("c", "plane"))
    p = p.select("session", "epoch", "c", "width", "weight", F.posexplode("plane").alias("i", "v")).where(F.abs("v") < float("inf"))
    y, x = F.floor(F.col("i") / F.col("width")).cast("int"), (F.col("i") % F.col("width")).cast("int")
    return p.select("session", "epoch", "c", y.alias("y"), x.alias("x"), "v", "weight").groupBy(*STACK_KEYS).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("v")).alias("wv"), F.count("*").alias("coverage"))


def stack_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that adds a batch's sums to the stack of the batch before.

    Each batch writes a version of its own from the one before, so a batch that runs again
    makes the same one; the last two are kept.
    """

    def add(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        new = partial_stack(df)
        before = [k for k in versions(path) if k < batch]
        if before:
            old = spark.read.parquet(f"{path}/version={before[-1]}")
            new = old.select(new.columns).unionByName(new).groupBy(*STACK_KEYS).agg(*(F.sum(c).alias(c) for c in ("w", "wv", "coverage")))
        new.write.mode("overwrite").parquet(f"{path}/version={batch}")
        for k in before[:-1]:
            s, p = store.at(f"{path}/version={k}")
            s.delete_dir(p)

    return add


def versions(path: str) -> list[int]:
    """Whole versions of a stack, oldest first."""
    from pyarrow import fs

    s, p = store.at(path)
    found = s.get_file_info(fs.FileSelector(p, recursive=True, allow_not_found=True))
    return sorted(int(f.path.split("version=")[1].split("/")[0]) for f in found if f.base_name == "_SUCCESS")


def read_stack(spark: SparkSession, path: str) -> DataFrame:
    """STACK_KEYS, mean (0 without weight) and coverage of the newest version."""
    s = spark.read.parquet(f"{path}/version={versions(path)[-1]}")
    return s.select(*STACK_KEYS, F.when(F.col("w") > 0, F.col("wv") / F.col("w")).otherwise(0.0).alias("mean"), "coverage")


# ---- alerts by timer


ALERTS = "session string, at double, action string, seconds double"
#: What a session's rows tell: start (with its deadline, or null) and frame (accepted or not).
TICKS = "session string, at double, kind string, accepted boolean, sub_seconds double, deadline double"


@dataclass(frozen=True)
class Clock:
    """When things last happened to a session, in seconds, and what was said since."""

    update: float | None = None
    accepted: float | None = None
    sub: float = 0.0
    deadline: float | None = None
    stalled: bool = False
    safeguarded: bool = False
    ended: bool = False


@dataclass(frozen=True)
class Alerts:
    """Stalled strictly after max(factor sub exposures, least) seconds; idle at so many minutes after an accepted frame."""

    factor: float = 3.0
    least: float = 90.0
    idle_minutes: float = 30.0
    retry: float = 1.0

    def tell(self, c: Clock, kind: str, at: float, accepted: bool, sub: float | None, deadline: float | None) -> Clock:
        if kind == "start":
            return replace(c, deadline=deadline, ended=False)
        c = replace(c, update=max(at, c.update or at), sub=c.sub if sub is None else sub, stalled=False)
        return replace(c, accepted=max(at, c.accepted or at), safeguarded=False) if accepted else c

    def next(self, c: Clock) -> tuple[float, str] | None:
        """The next alert and its time; the planned stop comes first where two are due at once."""
        due = []
        if c.deadline is not None and not c.ended:
            due.append((c.deadline, 0, "end_session"))
        if c.accepted is not None and not c.safeguarded:
            due.append((c.accepted + 60 * self.idle_minutes, 1, "safeguard"))
        if c.update is not None and not c.stalled:
            due.append((math.nextafter(c.update + max(self.factor * c.sub, self.least), math.inf), 2, "stalled"))
        return (min(due)[0], min(due)[2]) if due else None

    def fire(self, c: Clock, now: float) -> tuple[Clock, list[tuple[str, float]]]:
        """What is due by now, each once an episode; a planned stop lets a safeguard that is due wait for the next look."""
        out: list[tuple[str, float]] = []
        while (n := self.next(c)) and n[0] <= now:
            if n[1] == "safeguard" and any(a == "end_session" for a, _ in out):
                break
            since = {"end_session": c.deadline, "safeguard": c.accepted, "stalled": c.update}[n[1]]
            out.append((n[1], now - since))
            c = replace(c, **{{"end_session": "ended", "safeguard": "safeguarded", "stalled": "stalled"}[n[1]]: True})
        return c, out


class Watchdog(StatefulProcessor):
    def __init__(self, alerts: Alerts):
        self.alerts = alerts

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clock", "update double, accepted double, sub double, deadline double, stalled boolean, safeguarded boolean, ended boolean")

    def _at(self, c: Clock, now: float, key) -> list[tuple]:
        """Fires what is due, stores the clock and sets the one timer it needs."""
        c, said = self.alerts.fire(c, now)
        self.state.update(astuple(c))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if n := self.alerts.next(c):
            self.handle.registerTimer(math.ceil(max(n[0], now + self.alerts.retry if n[0] <= now else n[0]) * 1000))
        return [(key[0], now, action, seconds) for action, seconds in said]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c, out = Clock(*self.state.get()) if self.state.exists() else Clock(), []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            some = lambda v: None if pd.isna(v) else float(v)
            if r.kind == "frame":  # what was due before this frame came is said first
                c, said = self.alerts.fire(c, r.at)
                out += [(key[0], float(r.at), action, seconds) for action, seconds in said]
            c = self.alerts.tell(c, r.kind, float(r.at), r.accepted is True or r.accepted == True, some(r.sub_seconds), some(r.deadline))  # noqa: E712
        out += self._at(c, max(timerValues.getCurrentProcessingTimeInMs() / 1000, float("-inf") if not out else out[-1][1]), key)
        yield pd.DataFrame(out, columns=["session", "at", "action", "seconds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._at(Clock(*self.state.get()), expiredTimerInfo.getExpiryTimeInMs() / 1000, key)
        yield pd.DataFrame(out, columns=["session", "at", "action", "seconds"])

    def close(self) -> None:
        pass


def watchdog(ticks: DataFrame, alerts: Alerts = Alerts()) -> DataFrame:
    """ALERTS of a stream of TICKS: stalls, the idle safeguard and the planned stop, by timers, though no further row comes."""
    return ticks.groupBy("session").transformWithStateInPandas(Watchdog(alerts), ALERTS, "append", "processingTime")


# ---- progress and draining


def counted(frames: DataFrame, accepted: Column) -> DataFrame:
    """frames, whose numbers a Progress listener gets with every batch."""
    a = F.coalesce(accepted.cast("long"), F.lit(0))
    return frames.observe("frames", F.count("*").alias("processed"), F.sum(a).alias("accepted"), F.sum(1 - a).alias("rejected"))


class Progress(StreamingQueryListener):
    """Frames processed, accepted and rejected by each query so far; a batch that reports twice counts once."""

    def __init__(self) -> None:
        self.batches: dict[str, dict[int, tuple[int, int, int]]] = {}

    def of(self, query: str) -> tuple[int, int, int]:
        return tuple(map(sum, zip((0, 0, 0), *list(self.batches.get(str(query), {}).values()))))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if (m := p.observedMetrics.get("frames")) is not None:
            self.batches.setdefault(str(p.id), {})[p.batchId] = (m.processed or 0, m.accepted or 0, m.rejected or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class StillRunning(RuntimeError):
    """A query that neither ends nor stops: its session must not be committed."""


@dataclass(frozen=True)
class Windows:
    """Seconds: without progress, with a read under way, how many such windows are dead before giving up, and to stop."""

    quiet: float = 120.0
    reading: float = 60.0
    dead: int = 5
    stop: float = 10.0


def drain(query: StreamingQuery, windows: Windows = Windows(), seen: Callable[[], object] | None = None) -> bool:
    """Waits for an import as long as it gets on. True: it ended. False: it stalled and was stopped with what it had.

    Windows without progress end it, but a trigger that is running gets up to ``dead`` windows
    of its own to make some. A query that doesn't stop raises StillRunning. seen tells of
    progress; by default the batches that ended and their rows.
    """
    look = seen or (lambda: [(p["batchId"], p["numInputRows"]) for p in query.recentProgress[-3:]])
    last = look()
    while True:
        if query.awaitTermination(windows.quiet):
            return True
        now = look()
        if now != last:
            last = now
            continue
        for _ in range(windows.dead):
            if not query.status["isTriggerActive"]:
                break
            if query.awaitTermination(windows.reading):
                return True
            if look() != now:
                break
        if (now := look()) == last:
            break
        last = now
    stopper = threading.Thread(target=query.stop, daemon=True)
    stopper.start()
    stopper.join(windows.stop)
    if query.isActive:
        raise StillRunning("the import neither goes on nor stops")
    return False
