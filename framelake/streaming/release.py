"""In-order release of live folders as two stateful steps with timers.

``gate`` keeps state by file: an identity that repeats lets content be read, and mutable output
must show one digest twice, a quiet period apart. It passes on changes only, so a folder of
unchanged files costs nothing further down, and one large folder spreads over all tasks.

``release`` keeps state by folder, in map states whose entries are read and written singly: the
files that are open (not ready, or ready and held), what became of the others, and who waited
for whom. Numbered revisions leave in order, and that of a settled name may leave again with
new content as long as no higher one has left:

* the lowest open revision that isn't ready, the blocker, holds back all open ones above it;
* each of them, a victim, keeps a ledger: for every owner (revision) that held it back, since
  when and for how long. One segment runs at a time, that of the present blocker;
* a victim's ledger rests while it is away, is redeemed of an owner that is emitted after all,
  and is closed when the victim leaves or stands unblocked;
* once a ledger holds a budget's worth of waiting, and the blocker has had its own grace
  (renewed while it converges, up to a ceiling), the blocker is written off. What its own
  time lacks of the budget is taken from earlier owners' segments, oldest first, and its own
  segments go from all ledgers;
* a processing-time timer is set for when that will be, so it needs no further listing;
* a revision not above the highest emitted one is late and dropped.

State and emitted rows of a batch are committed together, so there is no time in which an
emission is pending. Times are seconds since 1970, of the look or of the timer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from framelake.streaming.watch import Policy, order, revision

#: What a look tells of a file: seen (present, unread), read (with a digest), invalid (unreadable), gone.
LOOKS = "folder string, generation long, at double, name string, kind string, identity string, digest string"
CHANGES = "folder string, generation long, at double, name string, kind string, digest string"
#: effect: emit, duplicate, late, write_off; held: seconds that a written-off blocker itself held others back.
EFFECTS = "folder string, generation long, at double, name string, effect string, digest string, held double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- by file


@dataclass(frozen=True)
class Progress:
    """How far one file is; phase observing, pending or ready."""

    generation: int
    identity: str
    digest: str | None = None
    since: float = 0.0
    phase: str = "observing"


def advance(was: Progress | None, generation: int, at: float, kind: str, identity: str | None, digest: str | None, policy: Policy) -> tuple[Progress | None, str | None]:
    """The next progress, and the change to pass on: unready, converging, ready, gone or none."""
    if was and generation < was.generation:
        return was, None
    if was and generation > was.generation:
        was = None
    if kind == "gone":
        return None, "gone"
    if kind == "invalid":
        return None, "unready"
    fresh = Progress(generation, identity or "")
    if was is None or was.identity != identity:
        return fresh, "unready"
    if kind != "read":
        return was, None
    now = Progress(generation, identity, digest, at, "ready")
    if was.phase == "ready" and was.digest == digest:
        return was, None
    if not policy.mutable:
        return now, "ready"
    if was.phase != "pending" or was.digest != digest:
        return Progress(generation, identity, digest, at, "pending"), "unready" if was.phase == "ready" else None
    return (now, "ready") if at - was.since >= policy.quiet else (was, "converging")


class Gate(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle) -> None:
        self.state = handle.getValueState("progress", "generation long, identity string, digest string, since double, phase string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = Progress(*self.state.get()) if self.state.exists() else None
        out = []
        for r in _sorted(rows):
            was, change = advance(was, int(r.generation), float(r.at), r.kind, _text(r.identity), _text(r.digest), self.policy)
            if change:
                out.append((*key[:1], int(r.generation), float(r.at), key[1], change, was.digest if was and change == "ready" else None))
        if was:
            self.state.update((was.generation, was.identity, was.digest, was.since, was.phase))
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def _sorted(frames: Iterator[pd.DataFrame]) -> Iterator[Any]:
    pdf = pd.concat(list(frames))
    return pdf.sort_values(["generation", "at"], kind="stable").rename(columns={"name": "file"}).itertuples(index=False)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def gate(looks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Changes of files from looks (LOOKS); one file's rows go to one state."""
    return looks.groupBy("folder", "name").transformWithStateInPandas(Gate(policy), CHANGES, "append", "none")


# ---- by folder


@dataclass
class Folder:
    """What is known of a folder's files; the mappings may be Spark's map states.

    open: name -> (ready, digest); settled: name -> (outcome, digest) in this generation; last:
    name -> digest of its last emission ever; debts: (victim, owner) -> (first charge, seconds,
    running since); grace: owner -> until; away: victims that went.
    """

    policy: Policy = field(default_factory=Policy)
    generation: int = 0
    high: str | None = None
    clock: float = -math.inf
    open: MutableMapping = field(default_factory=dict)
    settled: MutableMapping = field(default_factory=dict)
    last: MutableMapping = field(default_factory=dict)
    debts: MutableMapping = field(default_factory=dict)
    grace: MutableMapping = field(default_factory=dict)
    away: MutableMapping = field(default_factory=dict)

    def replace(self, generation: int) -> None:
        """The folder went and came again: of all that is known only the last digests stay."""
        self.generation, self.high = generation, None
        for m in (self.open, self.settled, self.debts, self.grace, self.away):
            for k in list(m):
                del m[k]

    def take(self, changes: list[tuple[str, str, str | None]], at: float, generation: int | None = None) -> list[tuple[str, str, str | None, float]]:
        """Effects (name, effect, digest, held) of changes (name, kind, digest) seen together; none of them at a timer."""
        if generation is not None and generation < self.generation:
            return []
        if generation is not None and generation > self.generation:
            self.replace(generation)
        self.clock = max(self.clock, at)
        out: list[tuple[str, str, str | None, float]] = []
        converging = set()
        for name, kind, digest in changes:
            if kind == "converging":
                converging.add(name)
            self._change(name, kind, digest, out)
        self._release(converging, out)
        return out

    def due(self) -> float | None:
        """When the blocker will be written off if nothing happens."""
        blocker, victims = self._blocked(self._numbered())
        if not victims:
            return None
        owner, soonest = _owner(blocker), math.inf
        for v in victims:
            first, _, _ = self.debts[v, owner]
            graced = min(first + self.policy.ceiling, max(first + self.policy.quiet, self.grace.get(owner, (-math.inf,))[0]))
            soonest = min(soonest, max(self.clock + max(0.0, self.policy.budget - self._total(v)), graced))
        return soonest

    # one change

    def _change(self, name: str, kind: str, digest: str | None, out: list) -> None:
        outcome = self.settled.get(name, (None,))[0]
        if kind == "gone":
            self.open.pop(name, None)
            if any(v == name for v, _ in self.debts):
                self.away[name] = (True,)
            return
        self.away.pop(name, None)
        if outcome in ("late", "lost"):
            return
        if kind != "ready":
            if outcome:  # a replacement on its way holds nobody back
                self.open.pop(name, None)
            else:
                self.open[name] = (False, None)
        elif self.last.get(name, (None,))[0] == digest:
            self.open.pop(name, None)
            if outcome is None:
                self.settled[name] = ("duplicate", digest)
            out.append((name, "duplicate", digest, 0.0))
        else:
            self.open[name] = (True, digest)

    # one pass

    def _numbered(self) -> list[str]:
        return sorted((n for n in self.open if revision(n)), key=lambda n: (order(revision(n)), revision(n), n)) if self.policy.mutable else []

    def _blocked(self, numbered: list[str]) -> tuple[str | None, list[str]]:
        k = next((k for k, n in enumerate(numbered) if not self.open[n][0]), None)
        return (None, []) if k is None else (numbered[k], numbered[k + 1 :])

    def _release(self, converging: set[str], out: list) -> None:
        free = [n for n in self.open if self.open[n][0] and not (self.policy.mutable and revision(n))]
        for n in sorted(free, key=lambda n: (order(revision(n) or ""), n)):
            self._emit(n, out)
        for n in self._numbered():
            self._drop_late(n, out)
        victims: list[str] = []
        while True:
            numbered = self._numbered()
            blocker, victims = self._blocked(numbered)
            for n in numbered[: numbered.index(blocker) if blocker else None]:
                if not self._drop_late(n, out):
                    self._emit(n, out)
            if not victims:
                break
            owner = _owner(blocker)
            for v in victims:
                self._charge(v, owner)
            if blocker in converging:
                self.grace[owner] = (self.clock + self.policy.quiet,)
            justifier = next((v for v in victims if self._justified(v, owner)), None)
            if justifier is None:
                break
            held = self._seconds(self.debts[justifier, owner])
            self._consume(justifier, owner, self.policy.budget - held)
            del self.open[blocker]
            self.settled[blocker] = ("lost", None)
            self._forget_owner(owner)
            out.append((blocker, "write_off", None, held))
        self._settle(set(victims))

    def _drop_late(self, name: str, out: list) -> bool:
        """Revisions not above the highest emitted one are dropped, but for new content of that very file."""
        if self.high is None or order(revision(name)) > order(self.high):
            return False
        outcome = self.settled.get(name, (None,))[0]
        if outcome == "emitted" and order(revision(name)) == order(self.high) and self.open[name][0]:
            return False
        digest = self.open.pop(name)[1]
        if outcome is None:
            self.settled[name] = ("late", digest)
        self._close(name)
        out.append((name, "late", digest, 0.0))
        return True

    def _emit(self, name: str, out: list) -> None:
        digest = self.open.pop(name)[1]
        self.settled[name], self.last[name] = ("emitted", digest), (digest,)
        out.append((name, "emit", digest, 0.0))
        rev = revision(name)
        if rev and self.policy.mutable:
            if self.high is None or order(rev) > order(self.high):
                self.high = rev
            self._close(name)
            self._forget_owner(_owner(name))

    # ledgers

    def _seconds(self, debt: tuple[float, float, float | None]) -> float:
        _, seconds, since = debt
        return seconds + (max(0.0, self.clock - since) if since is not None else 0.0)

    def _of(self, victim: str) -> list[str]:
        return [o for v, o in self.debts if v == victim]

    def _total(self, victim: str) -> float:
        return sum(self._seconds(self.debts[victim, o]) for o in self._of(victim))

    def _rest(self, victim: str, but: str | None = None) -> None:
        for o in self._of(victim):
            first, _, since = debt = self.debts[victim, o]
            if o != but and since is not None:
                self.debts[victim, o] = (first, self._seconds(debt), None)

    def _charge(self, victim: str, owner: str) -> None:
        self._rest(victim, but=owner)
        first, seconds, since = self.debts.get((victim, owner), (self.clock, 0.0, None))
        if since is None:
            self.debts[victim, owner] = (first, seconds, self.clock)

    def _justified(self, victim: str, owner: str) -> bool:
        first = self.debts[victim, owner][0]
        if self._total(victim) < self.policy.budget:
            return False
        graced = max(first + self.policy.quiet, self.grace.get(owner, (-math.inf,))[0])
        return self.clock >= min(graced, first + self.policy.ceiling)

    def _consume(self, victim: str, but: str, seconds: float) -> None:
        self._rest(victim)
        for o in sorted((o for o in self._of(victim) if o != but), key=lambda o: (self.debts[victim, o][0], order(o))):
            if seconds <= 0:
                break
            first, had, _ = self.debts[victim, o]
            if had > seconds:
                self.debts[victim, o] = (first, had - seconds, None)
            else:
                del self.debts[victim, o]
            seconds -= had

    def _forget_owner(self, owner: str) -> None:
        for k in [k for k in self.debts if k[1] == owner]:
            del self.debts[k]
        self.grace.pop(owner, None)

    def _close(self, victim: str) -> None:
        for o in self._of(victim):
            del self.debts[victim, o]

    def _settle(self, charged: set[str]) -> None:
        """Ledgers of those no longer held back are closed, of those that are away they rest."""
        unready = [n for n in self._numbered() if not self.open[n][0]]
        for v in {v for v, _ in self.debts} - charged:
            if v in self.away or any(order(revision(n)) < order(revision(v)) for n in unready):
                self._rest(v)
            else:
                self._close(v)
        live = {o for _, o in self.debts}
        for o in [o for o in self.grace if o not in live]:
            del self.grace[o]
        owing = {v for v, _ in self.debts}
        for v in [v for v in self.away if v not in owing]:
            del self.away[v]


def _owner(name: str) -> str:
    return revision(name).lstrip("0") or "0"


class Held(MutableMapping):
    """A map state as a mapping; keys of one column come without their tuple."""

    def __init__(self, state, width: int = 1):
        self.state, self.key = state, (lambda k: (k,)) if width == 1 else tuple
        self.bare = (lambda k: k[0]) if width == 1 else tuple

    def __getitem__(self, k):
        v = self.state.getValue(self.key(k)) if self.state.containsKey(self.key(k)) else None
        if v is None:
            raise KeyError(k)
        return tuple(v)

    def __setitem__(self, k, v) -> None:
        self.state.updateValue(self.key(k), v)

    def __delitem__(self, k) -> None:
        self.state.removeKey(self.key(k))

    def __iter__(self):
        return iter([self.bare(k) for k in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self)


class Cached(dict):
    """A map state held in memory for one call and written back by entry: for the few open files and their ledgers."""

    def __init__(self, held: Held):
        super().__init__((k, held[k]) for k in held)
        self.held, self.was = held, dict(self)

    def save(self) -> None:
        for k in self.was.keys() - self.keys():
            del self.held[k]
        for k, v in self.items():
            if self.was.get(k) != v:
                self.held[k] = v


class Release(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "generation long, high string, clock double")
        one = lambda name, value: Held(handle.getMapState(name, "k string", value))
        self.few = {"open": one("open", "ready boolean, digest string"), "grace": one("grace", "until double"), "away": one("away", "away boolean")}
        self.few["debts"] = Held(handle.getMapState("debts", "victim string, owner string", "first double, seconds double, since double"), 2)
        self.all = {"settled": one("settled", "outcome string, digest string"), "last": one("last", "digest string")}

    def _run(self, key, work: Callable[[Folder], Iterator[tuple]]) -> pd.DataFrame:
        few = {k: Cached(v) for k, v in self.few.items()}
        folder = Folder(self.policy, **few, **self.all)
        if self.head.exists():
            folder.generation, folder.high, folder.clock = self.head.get()
        out = [(key[0], folder.generation, at, name, effect, digest, held) for at, (name, effect, digest, held) in work(folder)]
        for m in few.values():
            m.save()
        self.head.update((folder.generation, folder.high, folder.clock))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (due := folder.due()) is not None:
            self.handle.registerTimer(math.ceil(due * 1000))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EFFECTS.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        looks: dict[tuple[int, float], list] = {}
        for r in _sorted(rows):
            looks.setdefault((int(r.generation), float(r.at)), []).append((r.file, r.kind, _text(r.digest)))

        def work(folder: Folder) -> Iterator[tuple]:
            for (generation, at), changes in looks.items():
                for e in folder.take(sorted(changes, key=lambda c: c[0]), at, generation):
                    yield at, e

        yield self._run(key, work)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        yield self._run(key, lambda folder: ((at, e) for e in folder.take([], at)))

    def close(self) -> None:
        pass


def release(changes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Effects (EFFECTS) of a stream of changes, in order of the folder's revisions, with write-offs by timer.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass = ROCKSDB. While a
    query runs, timers need no rows; after a start Spark looks at them with the first batch,
    which the source of ``livefolder`` always makes.
    """
    return changes.groupBy("folder").transformWithStateInPandas(Release(policy), EFFECTS, "append", "processingTime")
