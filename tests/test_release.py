"""In-order release: cases, random schedules against a plain model that counts ticks, and the stream with its timers."""

import random
import time

import pytest

from framelake.streaming import release
from framelake.streaming.release import Folder, advance
from framelake.streaming.watch import Policy, order, revision

ROWS = Policy(quiet=0.5, poll=2.0)
BUDGET = ROWS.budget


def names(effects, kind="emit"):
    return [n for n, e, _, _ in effects if e == kind]


def ready(*revs, digest="d"):
    return [(f"s_{r}.fit", "ready", f"{digest}{r}") for r in revs]


def unready(*revs, kind="unready"):
    return [(f"s_{r}.fit", kind, None) for r in revs]


def gone(*revs):
    return [(f"s_{r}.fit", "gone", None) for r in revs]


def test_gate_asks_for_a_repeated_identity_then_a_repeated_digest():
    p, out = None, []
    for at, kind, identity, digest in [(0, "seen", "i", None), (1, "read", "i", "a"), (1.2, "read", "i", "a"), (1.6, "read", "i", "a"), (3, "read", "i", "a"), (4, "seen", "j", None), (5, "read", "j", "b"), (6, "read", "j", "c"), (7, "read", "j", "c"), (8, "invalid", None, None), (9, "gone", None, None)]:
        p, change = advance(p, 0, at, kind, identity, digest, ROWS)
        out.append(change)
    assert out == ["unready", None, "converging", "ready", None, "unready", None, None, "ready", "unready", "gone"] and p is None
    p, change = advance(None, 0, 0, "seen", "i", None, Policy(mutable=False))
    assert advance(p, 0, 1, "read", "i", "a", Policy(mutable=False))[1] == "ready"
    assert advance(p, 1, 1, "read", "i", "a", Policy(mutable=False))[1] == "unready"  # another generation starts anew
    assert advance(p, -1, 1, "gone", None, None, ROWS) == (p, None)


def test_blocker_is_written_off_at_its_due_time_and_victims_leave_in_order():
    f = Folder(ROWS)
    assert f.take(unready(1) + ready(3, 2, 10), 100.0) == []
    assert f.due() == 100.0 + BUDGET
    assert f.take([], 100.0 + BUDGET - 0.5) == []
    out = f.take([], f.due())
    assert out[0] == ("s_1.fit", "write_off", None, BUDGET) and names(out) == ["s_2.fit", "s_3.fit", "s_10.fit"]
    assert f.due() is None and not f.debts and not f.grace and not f.open
    assert names(f.take(ready(1), 200.0)) == []  # a lost file stays lost


def test_a_lone_blocker_owns_nothing():
    f = Folder(ROWS)
    f.take(unready(1), 0.0)
    assert f.due() is None and not f.debts and f.take([], 1e6) == []


def test_ledger_rests_while_its_victim_is_away():
    f = Folder(ROWS)
    f.take(unready(1) + ready(2), 0.0)
    f.take(gone(2), 20.0)
    assert f.due() is None
    f.take(ready(2), 1000.0)
    assert f.due() == 1000.0 + BUDGET - 20.0
    f.take(gone(1), 1001.0)
    assert not f.debts and f.settled["s_2.fit"][0] == "emitted"


def test_an_owner_that_is_emitted_redeems_what_it_cost():
    f = Folder(ROWS)
    f.take(unready(1, 2) + ready(3), 0.0)
    assert names(f.take(ready(1), 20.0)) == ["s_1.fit"]
    assert f.due() == 20.0 + BUDGET  # 2 starts with nothing to its charge


def test_earlier_owners_that_vanish_leave_their_debt_and_the_next_blocker_has_its_own_grace():
    f = Folder(ROWS)
    f.take(unready(1, 2) + ready(3), 0.0)
    f.take(gone(1), BUDGET - 1.0)
    assert f.due() == BUDGET
    out = f.take([], f.due())
    assert out[0] == ("s_2.fit", "write_off", None, 1.0)  # its own second; the rest was its predecessor's
    f = Folder(ROWS)
    f.take(unready(1, 2) + ready(3), 0.0)
    f.take(gone(1), BUDGET + 0.0)  # written off and gone at once: 2 gets a grace period
    assert names(f.take([], BUDGET)) == [] and f.due() == BUDGET + ROWS.quiet


def test_convergence_renews_grace_up_to_the_ceiling():
    f = Folder(ROWS)
    f.take(unready(1) + ready(2), 0.0)
    at, lost = 0.0, []
    while not lost and at < 100:
        at += 0.25
        lost = [e for e in f.take([("s_1.fit", "converging", None)], at) if e[1] == "write_off"]
    assert at == ROWS.ceiling == BUDGET + 4 * 0.5


def test_equal_revisions_and_replacements():
    f = Folder(ROWS)
    out = f.take(ready("007", "7"), 0.0)
    assert names(out) == ["s_007.fit"] and names(out, "late") == ["s_7.fit"]
    assert names(f.take(ready("007", digest="new"), 1.0)) == ["s_007.fit"]  # new content of the highest
    f.take(ready("8"), 2.0)
    out = f.take(ready("007", digest="newer"), 3.0)
    assert names(out) == [] and names(out, "late") == ["s_007.fit"] and f.settled["s_007.fit"][0] == "emitted"
    assert names(f.take(unready("8") + ready("9"), 4.0)) == ["s_9.fit"]  # a replacement on its way holds nobody back
    assert names(f.take(ready("8", digest="again"), 5.0), "late") == ["s_8.fit"]
    assert names(f.take(ready("9"), 6.0), "duplicate") == ["s_9.fit"]


def test_generations_keep_digests_only():
    f = Folder(ROWS)
    f.take(ready(5), 0.0, 0)
    f.take(unready(6) + ready(7), 1.0, 0)
    f.take(unready(2) + ready(3, 5), 2.0, 1)
    assert (f.generation, f.high) == (1, None) and f.settled["s_5.fit"][0] == "duplicate" and list(f.debts) == [("s_3.fit", "2")]
    assert f.take(ready(9), 3.0, 0) == []  # of an older generation
    assert names(f.take(ready(2), 4.0, 1)) == ["s_2.fit", "s_3.fit"]


def test_immutable_files_and_names_without_revision_wait_for_nobody():
    f = Folder(Policy(mutable=False))
    assert names(f.take(unready(1) + ready(3, 2), 0.0)) == ["s_2.fit", "s_3.fit"] and f.due() is None
    f = Folder(ROWS)
    assert names(f.take([*unready(1), ("b.fit", "ready", "x"), ("a.fit", "ready", "y")], 0.0)) == ["a.fit", "b.fit"]


class Plain:
    """The same promises by ticks: every tick charges its length to whoever blocks, then everything is looked at anew."""

    def __init__(self, policy, tick):
        self.p, self.tick = policy, tick
        self.files, self.done, self.last, self.high = {}, {}, {}, None
        self.debt, self.first, self.until, self.pairs, self.gone = {}, {}, {}, [], set()

    def step(self, changes, now):
        out = []
        for pair in self.pairs:
            self.debt[pair] += self.tick
        converging = set()
        for n, kind, d in sorted(changes):
            if kind == "gone":
                self.files.pop(n, None)
                self.gone.add(n)
                continue
            self.gone.discard(n)
            if self.done.get(n) in ("late", "lost"):
                continue
            if kind == "converging":
                converging.add(n)
            if kind != "ready":
                self.files.pop(n, None)
                if n not in self.done:
                    self.files[n] = None
            elif self.last.get(n) == d:
                self.files.pop(n, None)
                self.done.setdefault(n, "duplicate")
                out.append((n, "duplicate"))
            else:
                self.files[n] = d
        while True:
            todo = sorted(self.files, key=lambda n: (order(revision(n)), revision(n)))
            for n in list(todo):
                low = self.high is not None and order(revision(n)) <= order(self.high)
                again = self.done.get(n) == "emitted" and self.high is not None and order(revision(n)) == order(self.high) and self.files[n]
                if low and not again:
                    self.files.pop(n)
                    self.done.setdefault(n, "late")
                    self.clear(lambda v, o, n=n: v == n)
                    out.append((n, "late"))
                    todo.remove(n)
            if not todo or self.files[todo[0]] is None:
                break
            n = todo[0]
            self.last[n] = self.files.pop(n)
            self.done[n], self.high = "emitted", revision(n)
            out.append((n, "emit"))
            self.clear(lambda v, o, n=n: v == n or o == revision(n).lstrip("0"))
        self.pairs = []
        if len(todo) > 1:
            b, owner = todo[0], revision(todo[0]).lstrip("0")
            self.pairs = [(v, owner) for v in todo[1:]]
            for pair in self.pairs:
                self.debt.setdefault(pair, 0.0)
                self.first.setdefault(pair, now)
            if b in converging:
                self.until[owner] = now + self.p.quiet
            for v in todo[1:]:
                mine = {o: s for (w, o), s in self.debt.items() if w == v}
                start = self.first[v, owner]
                graced = now >= start + self.p.ceiling or now >= max(start + self.p.quiet, self.until.get(owner, 0))
                if sum(mine.values()) >= self.p.budget and graced:
                    lack = self.p.budget - mine.pop(owner)
                    for o in sorted(mine, key=lambda o: (self.first[v, o], order(o))):
                        if lack <= 0:
                            break
                        left = max(0.0, mine[o] - lack)
                        lack -= mine[o]
                        self.debt[v, o] = left
                        if not left:
                            self.clear(lambda w, q, v=v, o=o: (w, q) == (v, o))
                    self.files.pop(b)
                    self.done[b] = "lost"
                    self.clear(lambda w, o: o == owner)
                    self.until.pop(owner, None)
                    out.append((b, "write_off"))
                    return out + self.step0(now)
        blocked = {v for v, _ in self.pairs}
        lowest = todo[0] if todo else None
        for v in {v for v, _ in self.debt} - blocked:
            if v not in self.gone and not (lowest and order(revision(lowest)) < order(revision(v))):
                self.clear(lambda w, o, v=v: w == v)
        self.until = {o: u for o, u in self.until.items() if o in {o for _, o in self.debt}}
        return out

    def step0(self, now):
        self.pairs = []
        return self.step([], now)

    def clear(self, test):
        for pair in [pair for pair in self.debt if test(*pair)]:
            del self.debt[pair], self.first[pair]
        self.pairs = [pair for pair in self.pairs if pair in self.debt]


@pytest.mark.parametrize("seed", range(60))
def test_random_schedules_equal_the_plain_model(seed):
    """Timers and events only on one side, every tick on the other; the same effects at the same times."""
    r = random.Random(seed)
    policy, tick = Policy(quiet=0.5, poll=2.0), 0.5
    folder, plain = Folder(policy), Plain(policy, tick)
    mine, theirs = [], []
    for k in range(800):
        now = k * tick
        changes = {}
        while r.random() < 0.04:
            n = f"s_{r.randint(1, 4 + k // 80)}.fit"
            changes[n] = r.choice([(n, "unready", None), (n, "unready", None), (n, "converging", None), (n, "gone", None), (n, "ready", r.choice("abc"))])
        changes = sorted(changes.values())
        due = folder.due()
        if changes or due is not None and due <= now:
            assert due is None or due > now - tick
            mine += [(now, n, e) for n, e, _, _ in folder.take(changes, now)]
        theirs += [(now, n, e) for n, e in plain.step(changes, now)]
        assert mine == theirs, (now, changes)
    assert folder.high == plain.high


# ---- as a stream


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, release.ROCKSDB)
    yield spark
    spark.conf.set(key, old)


def feed(spark, path, rows):
    spark.createDataFrame([("f", 0, *r) for r in rows], release.LOOKS).coalesce(1).write.mode("append").parquet(path)


def start(spark, path, checkpoint, table, policy):
    src = spark.readStream.schema(release.LOOKS).parquet(path)
    out = release.release(release.gate(src, policy), policy)
    return out.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()


def wait(spark, table, n, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        try:
            rows = spark.read.schema(release.EFFECTS).parquet(table).collect()
        except Exception:  # not written yet
            rows = []
        if len(rows) >= n:
            return rows
        time.sleep(0.3)
    raise AssertionError(rows)


@pytest.mark.parametrize("restart", [False, True])
def test_a_timer_writes_off_without_another_listing_and_after_a_restart(rocks, tmp_path, restart):
    """Looks end; only the timer is left to release what is held. A query that starts again looks at its timers with its first batch, here one without rows."""
    policy = Policy(quiet=0.1, poll=0.2, floor=15.0)
    path, checkpoint, table = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    t = time.time()
    look = lambda at, n, d: [(at, n, "seen" if d is None else "read", "i", d)]
    feed(rocks, path, [row for n in (2, 3) for at, d in ((t, None), (t + 0.1, "x"), (t + 0.3, "x")) for row in look(at, f"s_{n}.fit", d)] + look(t, "s_1.fit", None) + [(t, "a.fit", "seen", "i", None), (t + 0.2, "a.fit", "read", "i", "y"), (t + 0.4, "a.fit", "read", "i", "y")])
    q = start(rocks, path, checkpoint, table, policy)
    assert [(r.name, r.effect) for r in wait(rocks, table, 1)] == [("a.fit", "emit")]
    if restart:
        q.stop()
        q = start(rocks, path, checkpoint, table, policy)
        feed(rocks, path, [])
    rows = wait(rocks, table, 4)
    q.stop()
    assert [(r.name, r.effect) for r in sorted(rows, key=lambda r: r["at"])][1:] == [("s_1.fit", "write_off"), ("s_2.fit", "emit"), ("s_3.fit", "emit")]
    off = next(r for r in rows if r.effect == "write_off")
    assert abs(off["at"] - (t + policy.budget)) < 0.02 and abs(off.held - policy.budget) < 0.02
