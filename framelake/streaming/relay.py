"""Relay: new files of a folder are copied to another one, whole or not at all, tick by tick.

A tick is one listing of the source, stored by its number. A file is stable if the tick before
saw it with the same size and time. Of the stable ones those are copied that the destination
lacks or holds at another size (a copy cut off by a crash, which is healed). The ticks' listings
and the destination's meet in joins; copies are made in tasks:

* to a hidden name of the task's own, so a task that dies or runs twice leaves nothing that a
  watcher of the destination sees;
* the source is looked at again after a moment and after the copy; if it changed, or the copy has
  another size, the copy goes and a later tick tries again;
* publishing is a rename, over a healed file too.

A relay of one session leaves alone what was there at its first tick. A source that can't be
listed gives no tick. What came of each file is stored by tick as well, and a tick that runs
again overwrites its own folders and finds published files already there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelake.operators import folder
from framelake.sources import store

LISTING = "name string, size long, mtime_ns long"
#: effect: relayed, healed, deferred (still being written), retry (changed during the copy, or an error).
OUTCOMES = "name string, size long, effect string, reason string"
#: Seconds between the two looks at a file right before its copy.
MOMENT = 0.05


def names_of(spark: SparkSession, path: str, glob: str) -> DataFrame | None:
    """The files of a folder that match; None without a folder."""
    found = store.listing(path)
    if found is None:
        return None
    rows = [(f.base_name, f.size, f.mtime_ns) for f in found if not f.base_name.startswith(".")]
    return spark.createDataFrame(rows, LISTING).where(folder.glob(F.col("name"), glob))


def due(now: DataFrame, before: DataFrame | None, there: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """What to do with a tick's files: (LISTING, action) copy, heal or defer; finished ones are left out."""
    new = now if baseline is None else now.join(baseline.select("name"), "name", "left_anti")
    new = new.join(there.select("name", F.col("size").alias("_size")), "name", "left").where("_size IS NULL OR _size <> size")
    same = before.select("name", "size", "mtime_ns", F.lit(True).alias("_stable")) if before is not None else now.limit(0).withColumn("_stable", F.lit(True))
    action = F.when(F.col("_stable").isNull(), "defer").when(F.col("_size").isNull(), "copy").otherwise("heal")
    return new.join(same, ["name", "size", "mtime_ns"], "left").select(*now.columns, action.alias("action"))


def copy(source: str, destination: str, name: str, size: int, mtime_ns: int, moment: float = MOMENT) -> tuple[str, str | None]:
    """Publishes one stable file; deferred or retry with a reason if it isn't what it was."""
    src, hidden = f"{source}/{name}", f"{destination}/.{name}.{uuid.uuid4().hex}.relaytmp"
    same = lambda: (info := store.stat(src)) is not None and (info.size, info.mtime_ns) == (size, mtime_ns)
    try:
        time.sleep(moment)
        if not same():
            return "deferred", "being written"
        to, path = store.at(hidden)
        with to.open_output_stream(path) as f:
            for part in store.chunks(src):
                f.write(part)
        made = store.stat(hidden)
        if not same() or made is None or made.size != size:
            store.remove(hidden)
            return "retry", "changed during the copy"
        healing = store.stat(f"{destination}/{name}") is not None
        to.move(path, store.at(f"{destination}/{name}")[1])
        return ("healed" if healing else "relayed"), None
    except OSError as e:
        store.remove(hidden)
        return "retry", str(e)[:200]


def carry_out(work: DataFrame, source: str, destination: str, moment: float = MOMENT) -> DataFrame:
    """OUTCOMES of due files, copied in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                effect, reason = ("deferred", "not yet stable") if r.action == "defer" else copy(source, destination, r.name_, int(r.size_), int(r.mtime_ns), moment)
                out.append((r.name_, int(r.size_), effect, reason))
            yield pd.DataFrame(out, columns=["name", "size", "effect", "reason"])

    plain = work.select(F.col("name").alias("name_"), F.col("size").alias("size_"), "mtime_ns", "action")
    # as many tasks as files, up to the cluster's parallelism: copies are slow, listings short
    return plain.repartition(work.sparkSession.sparkContext.defaultParallelism, "name_").mapInPandas(run, OUTCOMES)


def tick(spark: SparkSession, number: int, source: str, destination: str, state: str, glob: str = "*", session: bool = True, moment: float = MOMENT) -> DataFrame | None:
    """One pass; its outcomes are stored under state/outcomes and returned. None if the source isn't there."""
    listed = names_of(spark, source, glob)
    if listed is None:
        return None
    store.at(destination)[0].create_dir(store.at(destination)[1], recursive=True)
    here = f"{state}/ticks/tick={number}"
    listed.write.mode("overwrite").parquet(here)
    now = spark.read.schema(LISTING).parquet(here)
    done = sorted(int(f.rpartition("=")[2]) for f in _ticks(state))
    last = [k for k in done if k < number]
    at = lambda k: spark.read.schema(LISTING).parquet(f"{state}/ticks/tick={k}")
    work = due(now, at(last[-1]) if last else None, names_of(spark, destination, "*"), at(done[0]) if session else None)
    out = f"{state}/outcomes/tick={number}"
    carry_out(work, source, destination, moment).write.mode("overwrite").parquet(out)
    for k in last[1 if session else 0 : -1]:  # the first is the baseline, the last one is what this tick was compared with
        s, p = store.at(f"{state}/ticks/tick={k}")
        s.delete_dir(p)
    return spark.read.schema(OUTCOMES).parquet(out)


def _ticks(state: str) -> list[str]:
    from pyarrow import fs

    s, p = store.at(f"{state}/ticks")
    return [f.base_name for f in s.get_file_info(fs.FileSelector(p)) if f.base_name.startswith("tick=")]


def relay(spark: SparkSession, source: str, destination: str, state: str, glob: str = "*", session: bool = True, poll: float = 5.0) -> StreamingQuery:
    """Starts a stream that makes a tick every poll seconds; state is a folder that driver and executors share."""

    def one(_: DataFrame, batch: int) -> None:
        tick(spark, batch, source, destination, state, glob, session)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(one).option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime=f"{int(poll * 1000)} milliseconds").start()
