"""The median, percentile and spread conventions that operators differ in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def averaged_median(c: str | Column) -> Column:
    """Mean of the two middles where the count is even."""
    return F.median(c)


def upper_median(c: str | Column) -> Column:
    """The element at n/2 in order. Collects its group: use on tiles and windows, not on whole tables."""
    return F.element_at(F.array_sort(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int") + 1)


def nearest_rank(c: str | Column, p: float) -> Column:
    """The element at round(p (n - 1)), half up."""
    return F.element_at(F.array_sort(F.collect_list(c)), F.round(F.lit(p) * (F.count(c) - 1)).cast("int") + 1)


def upper_median_of(array: Column) -> Column:
    return F.element_at(F.array_sort(array), F.floor(F.size(array) / 2).cast("int") + 1)


def median_and_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: upper median and upper median of the distances from it."""
    a = df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_a"))
    a = a.withColumn("median", F.element_at("_a", F.floor(F.size("_a") / 2).cast("int") + 1))
    away = F.transform("_a", lambda v: F.abs(v - F.col("median")))
    return a.withColumn("mad", upper_median_of(away)).drop("_a")


def clamp(c: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(c, as_col(low)), as_col(high))


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def strided(df: DataFrame, index: Column, total: Column | int, most: int = 262_144) -> DataFrame:
    """Every stride-th row by index, where stride is total over most, rounded up."""
    total = F.lit(total) if isinstance(total, int) else total
    return df.where(F.pmod(index, F.greatest(F.lit(1), F.ceil(total / most))) == 0)
