"""Binary star catalogs: a 12-byte head, then ra, dec, mag as little-endian floats by declination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC, VERSION = b"LASC", 1
RECORD = np.dtype([("ra", "<f4"), ("dec", "<f4"), ("mag", "<f4")])


def encode(stars: np.ndarray) -> bytes:
    rec = np.zeros(len(stars), RECORD)
    for i, k in enumerate(("ra", "dec", "mag")):
        rec[k] = np.asarray(stars)[:, i]
    rec = rec[np.argsort(rec["dec"], kind="stable")]
    return MAGIC + np.array([VERSION, len(rec)], "<u4").tobytes() + rec.tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC or len(data) < 12:
        raise ValueError("not a star catalog")
    version, n = np.frombuffer(data, "<u4", 2, 4)
    if version != VERSION or len(data) < 12 + 12 * int(n):
        raise ValueError(f"version {version} with {n} stars in {len(data)} bytes isn't read")
    return np.frombuffer(data, RECORD, int(n), 12)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(ra, dec, mag); write it sorted by dec so that a declination band prunes row groups."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rec = decode(bytes(content))
                for k in range(0, len(rec), 100_000):
                    yield pd.DataFrame({c: rec[c][k : k + 100_000].astype(np.float64) for c in RECORD.names})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ra double, dec double, mag double")


def write(catalog: DataFrame, path: str, files: int = 8) -> None:
    catalog.repartitionByRange(files, "dec").sortWithinPartitions("dec").write.mode("overwrite").parquet(path)
