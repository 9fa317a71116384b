"""Agreement of a stack with another one of the same field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parity(pairs: DataFrame, keys: list[str], ours: str = "v", theirs: str = "t") -> DataFrame:
    """Pearson's r, and the mean absolute error after the least-squares line from ours to theirs."""
    f = pairs.groupBy(*keys).agg(F.corr(ours, theirs).alias("pearson"), F.coalesce(F.regr_slope(theirs, ours), F.lit(0.0)).alias("_s"), F.regr_intercept(theirs, ours).alias("_i"))
    away = F.avg(F.abs(F.col(theirs) - (F.col("_s") * F.col(ours) + F.col("_i"))))
    return pairs.join(f, keys).groupBy(*keys, "pearson").agg(away.alias("mae"))
