"""Session records: captions, totals, cadence, completion, summaries and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def caption(seconds: Column, frames: Column, sub: Column) -> Column:
    """"2h 14m · 402 × 20s": hours and minutes, or minutes and seconds, or seconds."""
    total = F.round(seconds).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    text = lambda c: c.cast("long").cast("string")
    time = F.when(h > 0, F.concat(text(h), F.lit("h "), text(m), F.lit("m"))).when(m > 0, F.when(s > 0, F.concat(text(m), F.lit("m "), text(s), F.lit("s"))).otherwise(F.concat(text(m), F.lit("m")))).otherwise(F.concat(text(s), F.lit("s")))
    each = F.when(sub % 1 == 0, text(sub)).otherwise(sub.cast("string"))
    return F.concat(time, F.lit(" · "), text(frames), F.lit(" × "), each, F.lit("s"))


def csv_field(c: Column) -> Column:
    """Quoted, with quotes doubled, where it holds a comma, quote or line break."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def value_or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("—"))


def slug(name: Column, most: int = 24) -> Column:
    """Lower-case letters and digits with single hyphens, at most 24 long, or "session"."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(s == "", "session").otherwise(s)


def session_ids(sessions: DataFrame, date: str, name: str, order: str) -> DataFrame:
    """id: date-slug, with -2, -3, ... for later ones of the same."""
    df = sessions.withColumn("_base", F.concat_ws("-", F.date_format(date, "yyyy-MM-dd"), slug(F.col(name))))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return df.withColumn("id", F.when(n == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", n.cast("string")))).drop("_base")


def fill_blank(user: Column, found: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(user), F.lit("")), found)


def totals(frames: DataFrame, session: str, accepted: Column, sub: Column) -> DataFrame:
    n = F.sum(accepted.cast("long"))
    return frames.groupBy(session).agg(n.alias("accepted"), F.sum((~accepted).cast("long")).alias("rejected"), F.sum(F.when(accepted, sub).otherwise(0.0)).alias("integration"))


def progress(frames: DataFrame, session: str, order: list[str], accepted: Column) -> DataFrame:
    """processed, accepted and rejected after each frame, and the session's total."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    a = F.sum(accepted.cast("long")).over(w)
    n = F.count("*").over(w)
    return frames.withColumns({"processed": n, "accepted": a, "rejected": n - a, "total": F.count("*").over(Window.partitionBy(session))})


def render_cadence(frames: DataFrame, session: str, order: list[str], renders: int = 60) -> DataFrame:
    """rendered: the first, every stride-th and the last frame; stride is total / renders, rounded."""
    n = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    total = F.count("*").over(Window.partitionBy(session))
    df = frames.withColumns({"index": n, "_total": total})
    stride = F.greatest(F.lit(1), F.round(F.col("_total") / renders).cast("long"))
    return df.withColumn("rendered", (F.col("index") == 1) | (F.col("index") % stride == 0) | (F.col("index") == F.col("_total"))).drop("_total")


def planned_stop(anchor: Column, hour: Column, minute: Column) -> Column:
    """The first hour:minute at or after the anchor."""
    today = F.date_trunc("day", anchor) + F.make_interval(hours=hour, mins=minute)
    return F.when(today >= anchor, today).otherwise(today + F.expr("interval 1 day"))


def stalls(frames: DataFrame, session: str, ts: str, order: list[str], sub: Column, factor: float = 3.0, least: float = 90.0) -> DataFrame:
    """Gaps strictly longer than max(factor x sub, least) seconds, with the frame before them."""
    nxt = F.lead(ts).over(Window.partitionBy(session).orderBy(ts, *order))
    seconds = lambda c: F.unix_micros(F.to_timestamp(c)) / 1e6
    df = frames.withColumn("gap", seconds(nxt) - seconds(F.col(ts)))
    return df.where(F.col("gap") > F.greatest(factor * sub, F.lit(least)))


def idle_episodes(frames: DataFrame, session: str, ts: str, minutes: float) -> DataFrame:
    """Episodes without a frame for at least so many minutes, once each."""
    seconds = F.unix_micros(F.to_timestamp(F.col(ts))) / 1e6
    w = Window.partitionBy(session).orderBy(ts)
    df = frames.withColumns({"_s": seconds, "_n": F.lead(seconds).over(w)})
    return df.where(F.col("_n") - F.col("_s") >= minutes * 60).select(session, F.col(ts).alias("idle_from"), (F.col("_n") - F.col("_s")).alias("idle_seconds"))


def completion(looks: DataFrame, session: str, order: list[str], accepted: Column, deadline: Column, minutes: float) -> DataFrame:
    """action of each look at a session (rows in ``order``, time first): end_session, safeguard or null.

    The first look at or after the deadline ends the session. A look at least so many
    minutes after the last accepted frame fires the safeguard, once for each such frame;
    a look that ends the session fires nothing else, so the safeguard waits for the next.
    """
    past = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    now = F.col(order[0])
    df = looks.withColumns({"_last": F.last(F.when(accepted, now), ignorenulls=True).over(past), "_due": F.coalesce(now >= deadline, F.lit(False))})
    df = df.withColumn("_ends", F.col("_due") & (F.sum(F.col("_due").cast("int")).over(past) == 1))
    seconds = (F.unix_micros(F.to_timestamp(now)) - F.unix_micros(F.to_timestamp("_last"))) / 1e6
    df = df.withColumn("_idle", F.coalesce((seconds >= minutes * 60) & ~F.col("_ends"), F.lit(False)))
    episode = Window.partitionBy(session, "_last").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fires = F.col("_idle") & (F.sum(F.col("_idle").cast("int")).over(episode) == 1)
    return df.withColumn("action", F.when(F.col("_ends"), "end_session").when(fires, "safeguard")).drop("_last", "_due", "_ends", "_idle")


def master_outcome(frames: DataFrame, session: str) -> DataFrame:
    """no_frames, written or awaiting_seed from acceptances in the last epoch. frames: accepted, epoch."""
    last = F.max("epoch").over(Window.partitionBy(session))
    df = frames.withColumn("_in", F.col("accepted") & (F.col("epoch") == last))
    g = df.groupBy(session).agg(F.sum(F.col("accepted").cast("long")).alias("n"), F.sum(F.col("_in").cast("long")).alias("now"))
    return g.select(session, F.when(F.col("n") == 0, "no_frames").when(F.col("now") > 0, "written").otherwise("awaiting_seed").alias("outcome"))
