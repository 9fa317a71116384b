"""Session documents: manifests in JSON, frame CSV, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.session import caption, csv_field, markdown_cell, value_or_dash
from framelake.schema import MANIFEST
from framelake.sources import store

CSV_COLUMNS = ("index", "timestamp", "source_file", "snapshot_file", "estimated_integration_seconds", "sub_exposure_seconds", "width", "height", "mean", "median", "stddev")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a document; fields that a document lacks are null."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def manifest_json(sessions: DataFrame) -> DataFrame:
    """(session_id, json) with keys in order."""
    cols = sorted(c for c in sessions.columns)
    return sessions.select("session_id", F.to_json(F.struct(*cols), {"pretty": "true"}).alias("json"))


def write_manifests(sessions: DataFrame, path: str) -> None:
    """Written whole beside the old ones and then taken for them, by the committer of the file sink."""
    sessions.write.mode("overwrite").json(path)


def persist(sessions: DataFrame, root: str) -> DataFrame:
    """Replaces root/session_id/session.json of each session, whole and on its own: (session_id, path).

    Files are written by tasks under another name first and renamed, so a reader finds the old
    document or the new one; a task that runs again writes the same. A session whose
    master isn't written yet has no ended_at, so live.finish calls this as its commit.
    Of several rows of a session the one that comes last in the order of its fields counts.
    """

    def run(batches):
        for pdf in batches:
            paths = [f"{root}/{s}/session.json" for s in pdf["session_id"]]
            for path, text in zip(paths, pdf["json"]):
                store.write(path, text.encode())
            yield pd.DataFrame({"session_id": pdf["session_id"], "path": paths})

    one = manifest_json(sessions).groupBy("session_id").agg(F.max("json").alias("json"))
    return one.mapInPandas(run, "session_id string, path string")


def snapshots(manifests: DataFrame) -> DataFrame:
    return manifests.select("session_id", "sub_exposure_seconds", F.explode("snapshots").alias("s")).select("session_id", "sub_exposure_seconds", "s.*")


def iso(ts: Column) -> Column:
    """UTC with milliseconds, in a session whose time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def frame_csv(snaps: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, index, line): the column names at index 0 of each session, then its snapshots."""
    text = lambda c: iso(F.col(c)) if c == "timestamp" else F.col(c).cast("string")
    cells = [csv_field(F.coalesce(text(c), F.lit(""))) for c in CSV_COLUMNS]
    lines = snaps.select(session, F.col("index").cast("long").alias("index"), F.concat_ws(",", *cells).alias("line"))
    head = snaps.select(session).distinct().select(session, F.lit(0).cast("long").alias("index"), F.lit(",".join(CSV_COLUMNS)).alias("line"))
    return head.unionByName(lines)


def summary_markdown(manifests: DataFrame) -> DataFrame:
    """(session_id, markdown): the session, its equipment and its final stack, and the files to look at."""
    text = lambda c: F.col(c).cast("string")
    or_unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    sub = F.col("sub_exposure_seconds")
    seconds = F.concat(F.when(sub % 1 == 0, sub.cast("long").cast("string")).otherwise(sub.cast("string")), F.lit("s"))
    known, shots = F.col("stack_frame_count").isNotNull(), F.coalesce(F.size("snapshots"), F.lit(0))
    stack = F.col("stack_frame_count")
    # Fixed texts: sections and field names of the document.
    sections = {
        "Session": [("Session id", text("session_id")), ("Target", value_or_dash(F.col("target"))), ("Started", value_or_dash(iso(F.col("started_at")))), ("Ended", value_or_dash(iso(F.col("ended_at")))), ("Sub exposure", value_or_dash(seconds)), ("Snapshots", F.greatest(shots, F.lit(0)).cast("string"))],
        "Equipment and site": [("Telescope", value_or_dash(F.col("telescope"))), ("Camera", value_or_dash(F.col("camera"))), ("Mount", value_or_dash(F.col("mount"))), ("Filter", value_or_dash(F.col("filter"))), ("Location", value_or_dash(F.col("location"))), ("Bortle", value_or_dash(text("bortle"))), ("Notes", F.when(F.trim("notes") != "", F.col("notes")))],
        "Final stack": [
            ("Master expected", or_unknown(F.when(F.col("master_expected"), "yes").when(~F.col("master_expected"), "no"))), ("Master outcome", or_unknown(F.col("master_outcome"))),
            ("Current-stack frames", or_unknown(stack.cast("string"))), ("Current-stack integration", F.when(known, caption(stack * sub, stack, sub))),
            ("Session accepted", F.coalesce(text("accepted_frames"), F.greatest(shots, F.lit(0)).cast("string"))), ("Session rejected", or_unknown(text("rejected_frames"))),
        ],
    }
    files = ["- `session-summary.md` — this human-readable summary", "- `manifest.json` — machine-readable session record", "- `master.fit` — final native-stack master when written", "- `replay.mp4` — session replay when enabled", "- `latest.png` — latest preview image"]
    lines = [F.lit("# Session Summary"), F.lit("")]
    for title, rows in sections.items():
        lines += [F.lit(f"## {title}"), F.lit(""), F.lit("| Field | Value |"), F.lit("| --- | --- |")]
        # A row without a value is left out.
        lines += [F.concat(F.lit(f"| {name} | "), markdown_cell(v), F.lit(" |")) for name, v in rows] + [F.lit("")]
    lines += [F.lit("## Files to inspect"), F.lit(""), *map(F.lit, files), F.lit("")]
    return manifests.select("session_id", F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n").alias("markdown"))
