"""Live stacks, stalls and idleness over streams of frames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.stack import KAPPA, WARM_UP


def live_stack(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The incremental weighted mean and coverage; use output mode update or complete. pixels: keys, v, m, weight."""
    w = F.col("m") * F.col("weight")
    return pixels.groupBy(*keys).agg(F.when(F.sum(w) > 0, F.sum(w * F.col("v")) / F.sum(w)).otherwise(0.0).alias("mean"), F.sum("m").alias("coverage"))


def live_clip(rows: DataFrame, kappa: float = KAPPA["medium"], warm_up: int = WARM_UP) -> DataFrame:
    """Ordered clipping of scanlines as they come: (session, c, y, ord, row) to the clipped row.

    State is one scanline's count, mean and spread; frames of one trigger are taken in
    order of ``ord``, later triggers must come later.
    """
    import numpy as np

    def run(key, frames, state: GroupState):
        pdf = pd.concat(list(frames)).sort_values("ord")
        n, mean, m2 = (np.array(x, float) for x in state.get) if state.exists else (None, None, None)
        out = []
        for o, row in zip(pdf["ord"], pdf["row"]):
            v = np.asarray(row, float)
            if n is None:
                n, mean, m2 = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
            room = kappa * np.sqrt(m2 / np.maximum(n, 1))
            c = np.where(n >= max(2, warm_up), np.clip(v, mean - room, mean + room), v)
            n = n + 1
            away = c - mean
            mean = mean + away / n
            m2 = m2 + away * (c - mean)
            out.append((*key, int(o), c.tolist()))
        state.update((n.tolist(), mean.tolist(), m2.tolist()))
        yield pd.DataFrame(out, columns=["session", "c", "y", "ord", "row"])

    return rows.groupBy("session", "c", "y").applyInPandasWithState(run, "session long, c int, y int, ord long, row array<double>", "n array<double>, mean array<double>, m2 array<double>", "append", GroupStateTimeout.NoTimeout)


def idle_windows(frames: DataFrame, session: str, ts: str, seconds: float, late: str = "1 minute") -> DataFrame:
    """Runs of frames without a gap of so many seconds; a run closes when the watermark passes it.

    Where a run ends an idle (or stalled) episode begins.
    """
    f = frames.withColumn("_ts", F.to_timestamp(ts)).withWatermark("_ts", late)
    w = F.session_window("_ts", f"{int(seconds * 1000)} milliseconds")
    out = f.groupBy(session, w.alias("w")).agg(F.count("*").alias("frames"), F.max("_ts").alias("last_frame"))
    return out.select(session, F.col("w.start").alias("first_frame"), "last_frame", "frames")


def snapshot_sink(path: str):
    """A foreachBatch writer that a repeated batch overwrites: one folder for each batch id."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


#: Seconds a stream gets to finish, window after window: live sessions.
DRAIN = (10, 5)


def finish(query: StreamingQuery, master: Callable[[], None], commit: Callable[[], None], windows: tuple[float, ...] = DRAIN) -> bool:
    """Waits for an availableNow query window by window, then writes the master and only then commits the session.

    Runs out of windows: the query is stopped, nothing is written, False. A failed query
    raises; a failed master leaves the session uncommitted.
    """
    if not any(query.awaitTermination(w) for w in windows):
        query.stop()
        return False
    master()
    commit()
    return True
