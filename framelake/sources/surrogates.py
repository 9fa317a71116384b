"""The driver's tables in the roles of frames, masters, stars, snapshots and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 mono frames (frame, session, y, x, v) with a coverage mask m."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("session"), F.posexplode("embedding").alias("i", "e"))
    y, x = F.expr("cast(i div 8 as bigint)"), F.expr("cast(i % 8 as bigint)")
    out = e.select("frame", "session", y.alias("y"), x.alias("x"), (F.col("e").cast("double") + 0.5).alias("v"))
    return out.withColumn("m", F.when((F.col("frame") * 7 + F.col("y") + F.col("x")) % 11 == 0, 0).otherwise(1))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, width, height, pixels): the frames of px, one a row."""
    v = F.transform("embedding", lambda e: e.cast("double") + 0.5)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(8).alias("width"), F.lit(8).alias("height"), v.alias("pixels"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, session, stars, sigma)"""
    f = px(spark, sf_dir).groupBy("frame", "session").agg(F.stddev_pop("v").alias("sigma"))
    return f.withColumn("stars", 15 + F.col("frame") % 45)


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-channel images (image, c, y, x, v): whole triples of frames."""
    p = px(spark, sf_dir).select(F.expr("frame div 3").alias("image"), (F.col("frame") % 3).alias("c"), "y", "x", "v")
    ids = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 3").alias("image"), "vec_id").distinct()
    whole = ids.groupBy("image").count().where("count = 3").select("image")
    return p.join(whole, "image", "left_semi")


def dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).where("session = 0").groupBy("y", "x").agg(F.avg("v").alias("d"))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).where("session = 1").groupBy("y", "x").agg(F.avg("v").alias("f"))


def stars(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """(frame, session, star, sx, sy, flux): the brightest pixels of each frame."""
    w = Window.partitionBy("frame").orderBy(F.desc("v"), "y", "x")
    p = px(spark, sf_dir).withColumn("star", F.row_number().over(w).cast("long") - 1).where(F.col("star") < most)
    return p.select("frame", "session", "star", (F.col("x") * F.lit(16.0)).alias("sx"), (F.col("y") * F.lit(16.0)).alias("sy"), F.col("v").alias("flux"))


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", "event_type", F.col("value").alias("median"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("Light_"), F.col("user_id"), F.lit("_"), F.col("event_id"), F.lit(".fit"))
    return e.select(name.alias("name"), F.col("user_id").alias("session"), "event_id", F.col("ts").alias("mtime"), (F.col("event_id") % 7).alias("size"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(star, ra, dec, mag) in degrees and magnitudes."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("double")
    return p.select(F.col("p_partkey").alias("star"), ((k * F.lit(137.508)) % 360.0).alias("ra"), ((k * F.lit(61.803)) % 180.0 - 90.0).alias("dec"), ((F.col("p_retailprice") - 900.0) / 10.0).alias("mag"))
