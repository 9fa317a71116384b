"""Folder listings: filters, orders, revisions, retention and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = ("fit", "fits", "fts", "png", "jpg", "jpeg", "tif", "tiff")


def glob(name: Column, pattern: str) -> Column:
    """Whole-name match where * stands for anything."""
    return name.rlike("^" + ".*".join("\\Q" + p + "\\E" if p else "" for p in pattern.split("*")) + "$")


def tracked(name: Column, prefix: str = "") -> Column:
    """Neither hidden nor .tmp, a known extension, and the prefix in any case."""
    low = F.lower(name)
    return ~name.startswith(".") & ~low.endswith(".tmp") & low.startswith(prefix.lower()) & F.regexp_extract(low, r"\.([a-z]+)$", 1).isin(*EXTENSIONS)


def natural_key(name: Column) -> Column:
    """A sort key by which runs of digits compare as numbers, in any case."""
    low = F.lower(name)
    # Digits after their own number of digits: longer runs are greater, however long.
    number = lambda d: F.concat(F.lpad(F.length(d).cast("string"), 9, "0"), d)
    parts = F.regexp_extract_all(low, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)), "")


def revision(name: Column) -> Column:
    """The digits that end the stem, or null."""
    return F.nullif(F.regexp_extract(name, r"([0-9]+)(?:\.[A-Za-z]+)?$", 1), F.lit(""))


def revision_key(rev: Column) -> Column:
    """Orders revisions of any length as numbers: no revision first, then digits without leading zeros by length."""
    bare = F.regexp_replace(rev, "^0+", "")
    return F.struct(F.coalesce(F.length(bare), F.lit(-1)).alias("n"), F.coalesce(bare, F.lit("")).alias("bare"), F.coalesce(rev, F.lit("")).alias("raw"))


def high_water(files: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """high: the largest value up to each row; late: whether a row is not above those before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumns({"high": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "late": F.coalesce(value <= before, F.lit(False))})


def changed(files: DataFrame, name: str, order: list[str], digest: Column) -> DataFrame:
    """emitted: whether the digest differs from the last one of the same name."""
    df = files.withColumn("digest", digest)
    before = F.lag("digest").over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("emitted", ~F.col("digest").eqNullSafe(before))


def prunable(dirs: DataFrame, today: Column, days: int, exclude: str | None = None) -> DataFrame:
    """Folders whose name's last date is over so many days old; none if days is 0 or less."""
    if days <= 0:
        return dirs.limit(0)
    found = F.regexp_extract_all("name", F.lit("([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1))
    last = F.try_to_date(F.try_element_at(found, F.lit(-1)), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_element_at(found, F.lit(-1)))
    out = dirs.where(F.coalesce(last < F.date_sub(today, days), F.lit(False)))
    return out.where(~F.col("name").rlike(exclude)) if exclude else out


def newest_valid(files: DataFrame, keys: list[str], mtime: str, valid: Column, keep: list[str]) -> DataFrame:
    """The newest valid file of each key; ties go to the larger name."""
    v = F.max_by(F.struct(*keep), F.struct(mtime, "name"))
    return files.where(valid).groupBy(*keys).agg(v.alias("r")).select(*keys, "r.*")


def complete(length: Column, header_bytes: Column, data_bytes: Column) -> Column:
    return length >= header_bytes + data_bytes


def footprint(files: DataFrame, keys: list[str], name: str, size: str) -> DataFrame:
    """(keys, n_files, bytes) of the files that are not hidden."""
    return files.where(~F.col(name).startswith(".")).groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes"))


def directory_footprint(spark: SparkSession, path: str) -> DataFrame:
    """(n_files, bytes) below path, from listings alone: no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return footprint(found.withColumn("name", F.element_at(F.split("path", "/"), -1)), [], "name", "length")


def device_folders(listing: DataFrame, keys: list[str], device: Column, mtime: str, keep: list[str]) -> DataFrame:
    """The newest folder of each device: (keys, device, keep, mtime); ties go to the greatest of keep."""
    newest = F.max(F.struct(mtime, *keep)).alias("b")
    rows = listing.withColumn("device", device).where("device is not null")
    return rows.groupBy(*keys, "device").agg(newest).select(*keys, "device", *[F.col(f"b.{c}") for c in keep], F.col(f"b.{mtime}"))


def union_of_names(*listings: DataFrame, name: str = "name") -> DataFrame:
    """Every name in any of the listings, once."""
    out = listings[0].select(name)
    for other in listings[1:]:
        out = out.union(other.select(name))
    return out.distinct()


def disjoint(sets: DataFrame, others: DataFrame, owner: str, member: str) -> DataFrame:
    """(owner, disjoint): whether none of an owner's members is among the others' members."""
    met = sets.join(others.select(member).distinct().withColumn("_met", F.lit(1)), member, "left")
    return met.groupBy(owner).agg((F.count("_met") == 0).alias("disjoint"))
