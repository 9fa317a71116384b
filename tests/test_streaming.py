import random
import time

import pytest
from pyspark.sql import functions as F

from framelake.operators import stack
from framelake.streaming import live, watch
from framelake.streaming.watch import Folder, Policy, step


def listing(*files):
    return [{"name": n, "identity": i, "digest": d} for n, i, d in files]


def drive(listings, policy=Policy(), start=None, every=1.0):
    state, out = start or Folder(), []
    for k, seen in enumerate(listings):
        state, effects = step(state, seen, k * every, policy)
        out += [(n, e) for n, _, e in effects]
    return state, out


def test_mutable_output_needs_two_equal_looks():
    _, out = drive([listing(("a_1.fit", "i", "d"))] * 2)
    assert out == []
    _, out = drive([listing(("a_1.fit", "i", "d"))] * 3)
    assert out == [("a_1.fit", "emit")]
    _, out = drive([listing(("a.fit", "i", "d"))] * 2, Policy(mutable=False))
    assert out == [("a.fit", "emit")]


def test_duplicates_and_generations():
    state, out = drive([listing(("a.fit", "i", "d"))] * 3)
    assert out == [("a.fit", "emit")]
    for k in range(3):
        state, effects = step(state, listing(("a.fit", "j", "d")), 10.0 + k, Policy())
        out += [(n, e) for n, _, e in effects]
    assert out[1:] == [("a.fit", "duplicate")]
    state, _ = step(state, [], 20.0, Policy(), generation=1)
    assert state.files == {} and state.emitted == {"a.fit": "d"}


def test_order_late_and_write_off():
    two, one = ("s_2.fit", "i", "d2"), ("s_1.fit", "i", None)
    _, out = drive([listing(one, two)] * 5)
    assert out == []
    _, out = drive([listing(one, two)] * 40)
    assert out == [("s_1.fit", "write_off"), ("s_2.fit", "emit")]
    _, out = drive([listing(two)] * 3 + [listing(("s_1.fit", "i", "d1"), two)] * 3)
    assert out == [("s_2.fit", "emit"), ("s_1.fit", "late")]
    assert watch.order("007") == watch.order("7") < watch.order("10")


@pytest.mark.parametrize("seed", range(20))
def test_random_listings_keep_the_promises(seed):
    r = random.Random(seed)
    state, emitted = Folder(), []
    files = {}
    for k in range(120):
        if r.random() < 0.5:
            files[f"s_{r.randint(1, 12)}.fit"] = (f"i{r.randint(0, 3)}", r.choice(["a", "b", None]))
        if r.random() < 0.1 and files:
            files.pop(r.choice(sorted(files)))
        state, effects = step(state, listing(*((n, i, d) for n, (i, d) in files.items())), k * 0.7, Policy())
        for n, d, e in effects:
            if e == "emit":
                before = [x for x in emitted if x[0] == n]
                assert not before or before[-1][1] != d  # never the same content of a name twice in a row
                emitted.append((n, d))
        assert Folder.from_json(state.to_json()) == state
    firsts = [n for i, (n, _) in enumerate(emitted) if n not in [m for m, _ in emitted[:i]]]
    keys = [watch.order(watch.revision(n)) for n in firsts]
    assert keys == sorted(keys)


def run_stream(spark, df, sink_name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(sink_name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(sink_name)


def test_streamed_watcher_equals_step(spark, tmp_path):
    rows = [("f", k, float(k), n, "i", d) for k in range(4) for n, d in (("s_1.fit", "x"), ("s_2.fit", "y"))]
    schema = "folder string, k int, at double, name string, identity string, digest string"
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[1] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("generation", F.lit(0))
    got = [(r.name, r.effect) for r in run_stream(spark, watch.watch(src), "watched").orderBy("at", "name").collect()]
    assert got == [("s_1.fit", "emit"), ("s_2.fit", "emit")]


def test_live_stack_equals_batch(spark, tmp_path):
    rows = [(f, p, 0.1 * f + p, (f + p) % 3 and 1, 1.0 + f) for f in range(6) for p in range(4)]
    schema = "frame int, p int, v double, m int, weight double"
    for k in (0, 1, 2):
        spark.createDataFrame([r for r in rows if r[0] % 3 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.p: (round(r["mean"], 9), r.coverage) for r in run_stream(spark, live.live_stack(src, ["p"]), "stacked", "complete").collect()}
    want = {r.p: (round(r["mean"], 9), r.coverage) for r in stack.weighted_mean(spark.createDataFrame(rows, schema), ["p"], weight="weight").collect()}
    assert got == want


def test_live_clip_equals_batch(spark, tmp_path):
    schema = "session long, c int, y int, ord long, row array<double>"
    rows = [(1, 0, 0, o, [0.1 * (o % 4), 9.0 if o == 11 else 0.5]) for o in range(14)]
    for k in range(2):
        spark.createDataFrame(rows[7 * k : 7 * k + 7], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # the file source goes by modification time
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {r.ord: r.row for r in run_stream(spark, live.live_clip(src), "clipped").collect()}
    assert len(out) == 14 and out[11][1] == 0.5 and out[10] == rows[10][4]


def test_idle_windows(spark, tmp_path):
    spark.sql("select 1 as s, explode(array(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:30', timestamp'2024-01-01 01:00:00', timestamp'2024-01-01 03:00:00')) as ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("s int, ts timestamp").parquet(str(tmp_path / "in"))
    got = sorted(r.frames for r in run_stream(spark, live.idle_windows(src, "s", "ts", 600), "idle").collect())
    assert got == [1, 2]


def test_snapshot_sink_is_idempotent(spark, tmp_path):
    write = live.snapshot_sink(str(tmp_path))
    write(spark.range(5), 0)
    write(spark.range(5), 0)
    write(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path)).count() == 8


def test_policy_replaces_invalid_intervals():
    assert Policy(quiet=-1, poll=float("nan")) == Policy() and Policy(quiet=float("inf"), poll=0).poll == 2.0 and Policy(quiet=0.1).quiet == 0.1


def test_looks_at_a_folder_feed_the_watcher(spark, tmp_path):
    inbox, table = tmp_path / "inbox", tmp_path / "looks"
    inbox.mkdir()
    for name in ("s_2.fit", "s_10.FIT", ".hidden.fit", "notes.txt"):
        (inbox / name).write_bytes(name.encode())
    q = watch.looks(spark, str(inbox), str(table), str(tmp_path / "ck"), Policy(poll=0.2))
    deadline = time.time() + 60
    while len(list(table.glob("look=*/_SUCCESS"))) < 4 and time.time() < deadline and q.isActive:
        time.sleep(0.2)
    q.stop()
    seen = spark.read.parquet(str(table))
    assert {r.name for r in seen.select("name").distinct().collect()} == {"s_2.fit", "s_10.FIT"}
    src = spark.readStream.schema(seen.drop("look").schema).parquet(str(table))
    assert [(r.name, r.effect) for r in run_stream(spark, watch.watch(src), "looked").orderBy("at", F.length("name")).collect()] == [("s_2.fit", "emit"), ("s_10.FIT", "emit")]
    got = watch.import_order(watch.listing(spark, str(inbox), 0.0, prefix="S_"))
    assert [r.name for r in got.collect()] == ["s_2.fit", "s_10.FIT"]


def test_finish_writes_the_master_before_it_commits(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    done = []
    q = src.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    assert live.finish(q, lambda: done.append("master"), lambda: done.append("commit"), (60, 60)) and done == ["master", "commit"]
    q = src.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "b")).trigger(processingTime="1 hour").start()
    assert not live.finish(q, lambda: done.append("no"), lambda: done.append("no"), (0.5, 0.5)) and not q.isActive and done == ["master", "commit"]
