"""Tables and options. Fields added later are nullable; reading fills defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def struct(columns: str, *more: T.StructField) -> T.StructType:
    """Fields from "name type, ..." without a session, and more after them."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))] + list(more))


FRAMES = struct(
    "path string, length long, mtime timestamp, width int, height int, channels int, bitpix int, bayer string, bottom_up boolean, header_bytes int",
    T.StructField("header", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType()),
)
PIXEL_ROWS = struct("path string, c int, y int", T.StructField("row", T.ArrayType(T.FloatType())))
SNAPSHOT = struct("index int, timestamp timestamp, source_file string, snapshot_file string, estimated_integration_seconds double, width int, height int, mean double, median double, stddev double")
MANIFEST = struct(
    "session_id string, target string, telescope string, camera string, filter string, sub_exposure_seconds double, location string, bortle int, notes string, started_at timestamp, ended_at timestamp, mount string, master_expected boolean, stack_frame_count int,"
    " accepted_frames int, rejected_frames int, total_integration_seconds double, master_outcome string",
    T.StructField("snapshots", T.ArrayType(SNAPSHOT)),
)


@dataclass(frozen=True)
class Options:
    """Session options; missing keys of a stored document take these defaults."""

    file_prefix: str = ""
    poll_seconds: float = 2.0
    quiet_seconds: float = 0.5
    mutable_output: bool = False
    debayer: str = "malvar"
    rejection: str = "medium"
    weight_frames: bool = True
    level_gradients: bool = True
    scale_frames: bool = False
    crop_to_coverage: bool = True
    flatten_scale: float = 20.0
    flatten_smoothest: float = 0.5
    neutralize: bool = True
    stretch_target: float = 0.25
    shadows: float = 2.8
    black_point: float = 0.0
    midtone_strength: float = 0.0
    saturation: float = 1.0
    denoise: float = 0.0
    planned_stop_minute: int = -1
    idle_minutes: int = 30

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Options:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known and v is not None})
