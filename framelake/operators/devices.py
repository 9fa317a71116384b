"""Where a device is capturing: the newest folder of the right shape on a plausible volume.

folders has (volume, parent, name, mtime), parent being the path from the volume's root; files has
(volume, parent, name, mtime), parent being the folder the file is in. Ties of time go to the
greater name. Copies (volumes named backup, archive or clone) never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders below a volume's root, and the ending of capture folders, of the two devices.
WORKS, WORKS_END, LIGHTS = "MyWorks", "_sub", "Autorun/Light"
#: Names of the first device's volumes.
WORKS_VOLUME = r"^emmc images(-\d+)?$|seestar"


def is_copy(volume: Column) -> Column:
    return F.lower(volume).rlike("backup|archive|clone")


def is_works_volume(volume: Column) -> Column:
    return ~is_copy(volume) & F.lower(volume).rlike(WORKS_VOLUME)


def exposure(name: Column) -> Column:
    """Seconds from the first token that is a number and an s, between underscores."""
    token = F.filter(F.split(name, "_"), lambda t: t.rlike(r"^[0-9]+(\.[0-9]*)?s$"))
    return F.rtrim(F.try_element_at(token, F.lit(1)), F.lit("s")).try_cast("double")


def stamp(name: Column) -> Column:
    """YYYYMMDD-HHMMSS from a token of the stem, or null; as text it sorts by time."""
    token = F.filter(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_"), lambda t: t.rlike("^[0-9]{8}-[0-9]{6}$"))
    return F.try_element_at(token, F.lit(1))


def _newest(folders: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max_by(F.struct("volume", "parent", "name", "mtime"), F.struct("mtime", "name", "volume")).alias("_b")
    return folders.groupBy(*keys).agg(best).where("_b IS NOT NULL").select(*keys, "_b.*")


def works_folder(folders: DataFrame, files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, volume, folder, target, exposure): the newest *_sub folder under WORKS of a works volume.

    The target is its name; the exposure is that of its .fit file with the latest stamp, those
    without one before all others.
    """
    keys = keys or []
    named = (F.col("parent") == WORKS) & F.col("name").endswith(WORKS_END)
    best = _newest(folders.where(is_works_volume(F.col("volume")) & named), keys)
    best = best.select(*keys, "volume", F.concat_ws("/", "parent", "name").alias("folder"), F.expr(f"left(name, length(name) - {len(WORKS_END)})").alias("target"))
    fit = files.where(F.lower("name").endswith(".fit")).select(*keys, "volume", F.col("parent").alias("folder"), "name")
    newest = best.join(fit, [*keys, "volume", "folder"]).groupBy(*keys, "volume", "folder").agg(F.max_by("name", F.struct(F.coalesce(stamp(F.col("name")), F.lit("")), "name")).alias("_f"))
    return best.join(newest, [*keys, "volume", "folder"], "left").select(*keys, "volume", "folder", "target", exposure(F.col("_f")).alias("exposure"))


def lights_folder(folders: DataFrame, files: DataFrame, headers: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, volume, folder, target, exposure, extension): the newest folder with FITS files under LIGHTS of any volume but copies.

    headers (keys, volume, folder, exposure_seconds, extension) is what fits.newest_metadata tells
    of folders; without it, or where no header could be read, there is no exposure and the
    extension is fit.
    """
    keys = keys or []
    shaped = folders.where(~is_copy(F.col("volume")) & (F.col("parent") == LIGHTS)).withColumn("folder", F.concat_ws("/", "parent", "name"))
    filled = files.where(F.lower("name").rlike(r"\.(fit|fits)$")).select(*keys, "volume", F.col("parent").alias("folder")).distinct()
    best = _newest(shaped.join(filled, [*keys, "volume", "folder"], "left_semi"), keys)
    best = best.select(*keys, "volume", F.concat_ws("/", "parent", "name").alias("folder"), F.col("name").alias("target"))
    if headers is None:
        return best.select("*", F.lit(None).cast("double").alias("exposure"), F.lit("fit").alias("extension"))
    told = headers.select(*keys, "volume", "folder", "exposure_seconds", "extension")
    return best.join(told, [*keys, "volume", "folder"], "left").select(*keys, "volume", "folder", "target", F.col("exposure_seconds").alias("exposure"), F.coalesce("extension", F.lit("fit")).alias("extension"))
