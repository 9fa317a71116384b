"""Live folders: when is a file whole, new, and next in order.

``step`` is a pure function of (state, observations, now); the streaming operator keys it
by folder, because the numbered revisions of one folder are ordered among each other.

* A file is ready when its identity repeats; mutable output must show the same digest
  twice, a quiet period apart.
* A file whose digest is that of its name's last emission is a duplicate.
* Numbered revisions leave in order. A revision that is not ready holds back higher
  ready ones; the time they wait is charged to it, and when the charge of a waiting
  file passes the budget (and graces) the blocker is written off.
* A revision not above the highest emitted one is dropped as late, unless it is the
  emitted file itself with new content.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators import folder

#: Seconds and multiples that make the waiting budget.
BUDGET_FLOOR, QUIET_PERIODS, POLLS, GRACES = 30.0, 10, 5, 4
OUTPUT = "folder string, name string, digest string, effect string, at double"


@dataclass(frozen=True)
class Policy:
    """Seconds of quiet and between looks (what isn't a positive finite number takes the default), and the least budget."""

    quiet: float = 0.5
    poll: float = 2.0
    mutable: bool = True
    floor: float = BUDGET_FLOOR

    def __post_init__(self) -> None:
        for f in fields(self)[:2]:
            v = getattr(self, f.name)
            if not (math.isfinite(v) and v > 0):
                object.__setattr__(self, f.name, f.default)

    @property
    def budget(self) -> float:
        return max(self.floor, QUIET_PERIODS * self.quiet, POLLS * self.poll)

    @property
    def ceiling(self) -> float:
        return self.budget + GRACES * self.quiet


@dataclass
class Folder:
    """files: name -> [identity, digest, since, status]; status observing, pending, ready, emitted, duplicate, late or lost."""

    generation: int = 0
    files: dict[str, list] = field(default_factory=dict)
    emitted: dict[str, str] = field(default_factory=dict)
    high: str | None = None
    waits: dict[str, dict[str, float]] = field(default_factory=dict)
    last: float | None = None

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Folder:
        return cls(**json.loads(text))


def revision(name: str) -> str | None:
    stem = name.rsplit(".", 1)[0]
    digits = stem[len(stem.rstrip("0123456789")) :]
    return digits or None


def order(rev: str) -> tuple[int, str]:
    """Digits of any length as numbers."""
    bare = rev.lstrip("0")
    return len(bare), bare


def step(state: Folder, seen: list[dict], now: float, policy: Policy, generation: int = 0) -> tuple[Folder, list[tuple[str, str, str]]]:
    """The next state and effects (name, digest, emit | duplicate | late | write_off).

    seen: all present files with name, identity and digest (null while unread).
    """
    if generation != state.generation:  # the folder went and came again: only digests survive
        state = Folder(generation=generation, emitted=state.emitted)
    effects: list[tuple[str, str, str]] = []
    present = {o["name"] for o in seen}
    state.files = {n: f for n, f in state.files.items() if n in present}
    for o in seen:
        _observe(state, o, now, policy, effects)
    _release(state, now, policy, effects)
    state.last = now
    return state, effects


def _observe(state: Folder, o: dict, now: float, policy: Policy, effects: list) -> None:
    name, identity, digest = o["name"], o["identity"], o["digest"]
    f = state.files.get(name)
    if f is None or f[0] != identity:
        state.files[name] = [identity, None, now, "observing"]
        return
    if digest is None or f[3] in ("late", "lost") or f[3] in ("ready", "emitted", "duplicate") and f[1] == digest:
        return
    if state.emitted.get(name) == digest:
        if f[3] != "duplicate":
            effects.append((name, digest, "duplicate"))
        state.files[name] = [identity, digest, now, "duplicate"]
    elif not policy.mutable or f[3] == "pending" and f[1] == digest and now - f[2] >= policy.quiet:
        state.files[name] = [identity, digest, now, "ready"]
    elif f[1] != digest:
        state.files[name] = [identity, digest, now, "pending"]


def _release(state: Folder, now: float, policy: Policy, effects: list) -> None:
    def emit(name: str) -> None:
        f = state.files[name]
        effects.append((name, f[1], "emit"))
        f[3] = "emitted"
        state.emitted[name] = f[1]
        rev = revision(name)
        if rev and policy.mutable and (state.high is None or order(rev) > order(state.high)):
            state.high = rev
        for w in state.waits.values():
            w.pop(name, None)
        state.waits.pop(name, None)

    numbered = sorted((n for n in state.files if revision(n)), key=lambda n: (order(revision(n)), n))
    for n in sorted(n for n in state.files if not revision(n) and state.files[n][3] == "ready"):
        emit(n)
    if not policy.mutable:
        for n in numbered:
            if state.files[n][3] == "ready":
                emit(n)
        return
    for n in numbered:
        f = state.files[n]
        if state.high is not None and n not in state.emitted and order(revision(n)) <= order(state.high) and f[3] in ("observing", "pending", "ready"):
            f[3] = "late"
            effects.append((n, f[1] or "", "late"))
    while True:
        open_ = [n for n in numbered if state.files[n][3] in ("observing", "pending", "ready")]
        blocker = next((n for n in open_ if state.files[n][3] != "ready"), None)
        for n in open_[: open_.index(blocker) if blocker else len(open_)]:
            emit(n)
        victims = [n for n in open_[open_.index(blocker) + 1 :] if state.files[n][3] == "ready"] if blocker else []
        if not victims:
            return
        passed = max(0.0, now - state.last) if state.last is not None else 0.0
        for v in victims:
            w = state.waits.setdefault(v, {})
            w[blocker] = w.get(blocker, 0.0) + passed
        state.last = now  # time is charged once, whoever blocks next
        charged = max(sum(state.waits[v].values()) for v in victims)
        fresh = now - state.files[blocker][2] < policy.quiet
        if charged < policy.budget or fresh and charged < policy.ceiling:
            return
        state.files[blocker][3] = "lost"
        effects.append((blocker, state.files[blocker][1] or "", "write_off"))
        for v in victims:
            state.waits[v].pop(blocker, None)


def watch(observations: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Effects of a stream of listings: folder, generation, at (seconds), name, identity, digest.

    State is one folder's files. A listing is all rows of a folder with one ``at``.
    """

    def run(key, frames, state: GroupState):
        held = Folder.from_json(state.get[0]) if state.exists else Folder()
        pdf = pd.concat(list(frames)) if state is not None else None
        out = []
        for (at, generation), rows in pdf.sort_values(["at", "name"]).groupby(["at", "generation"], sort=True):
            seen = [{"name": r.name_, "identity": r.identity, "digest": r.digest if isinstance(r.digest, str) else None} for r in rows.rename(columns={"name": "name_"}).itertuples(index=False)]
            held, effects = step(held, seen, float(at), policy, int(generation))
            out += [(key[0], *e, float(at)) for e in effects]
        state.update((held.to_json(),))
        yield pd.DataFrame(out, columns=["folder", "name", "digest", "effect", "at"])

    return observations.groupBy("folder").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def listing(spark: SparkSession, path: str, at: float, generation: int = 0, prefix: str = "") -> DataFrame:
    """One look at a folder, as watch() takes them; the identity is size and time, the digest that of the bytes."""
    found = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    identity = F.concat_ws(":", "length", F.unix_micros("modificationTime"))
    seen = found.select(F.lit(path).alias("folder"), name.alias("name"), identity.alias("identity"), F.sha2("content", 256).alias("digest"))
    return seen.where(folder.tracked(F.col("name"), prefix)).withColumns({"at": F.lit(float(at)), "generation": F.lit(generation)})


def import_order(files: DataFrame, prefix: str = "") -> DataFrame:
    """The tracked files of a finite folder (name, ...) in natural order, by a distributed sort."""
    return files.where(folder.tracked(F.col("name"), prefix)).orderBy(folder.natural_key(F.col("name")), "name")


def looks(spark: SparkSession, path: str, into: str, checkpoint: str, policy: Policy = Policy(), prefix: str = "") -> StreamingQuery:
    """Starts a stream that looks at a folder every policy.poll seconds and appends each listing to a table for watch().

    A repeated batch overwrites its own folder, so no look is listed twice.
    """

    def look(_: DataFrame, batch_id: int) -> None:
        listing(spark, path, time.time(), prefix=prefix).write.mode("overwrite").parquet(f"{into}/look={batch_id}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(policy.poll * 1000)} milliseconds").start()
