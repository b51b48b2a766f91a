"""Expressions on sonar and photon tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def age_weight(year: Column, now: int = 2024, oldest: int = 1980) -> Column:
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), 1 - (F.lit(now) - year) / float(now - oldest)))


def sonar_uncertainty(z: Column, crosstrack: Column, speed: Column) -> Column:
    depth, cross = (0.25 + 0.02 * F.abs(z)) * 0.51, 0.005 * F.abs(crosstrack)
    fast = F.least(F.lit(14.0), F.abs(speed - 14)) * 0.51
    return F.sqrt(depth * depth + cross * cross + fast * fast)


def sonar_quality(df: DataFrame) -> DataFrame:
    return df.where("beamflag = 0 and speed > 2 and abs(roll) < 10 and abs(grazing) > 20 and abs(slope) < 50")


def segment_noise(df: DataFrame, segment: str, h: str, cls: str, k: float = 3) -> DataFrame:
    """Class 0 for photons beyond k interquartile ranges of their segment."""
    w = W.partitionBy(segment)
    q1, q3 = F.percentile(h, 0.25).over(w), F.percentile(h, 0.75).over(w)
    out = (F.col(h) < q1 - k * (q3 - q1)) | (F.col(h) > q3 + k * (q3 - q1))
    return df.withColumn(cls, F.when(out, 0).otherwise(F.col(cls)))


def reflectance(df: DataFrame, segment: str, signal: Column, per: float = 29) -> DataFrame:
    n = F.sum(signal.cast("int")).over(W.partitionBy(segment))
    return df.withColumn("reflectance", F.least(F.lit(4.0), n / per))


def segment_statistics(df: DataFrame, segment: str, h: str) -> DataFrame:
    return df.groupBy(segment).agg(F.median(h).alias("median"), F.stddev_samp(h).alias("std"), F.count("*").alias("n"), F.max(h).alias("max"), F.min(h).alias("min"))


def islands(df: DataFrame, by: str, at: Column, gap: float, order: list) -> DataFrame:
    """Numbers runs within ``by`` whose steps are at most ``gap``."""
    w = W.partitionBy(by).orderBy(*order)
    step = F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__step", step).withColumn("island", F.sum("__step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__step")


def rolling(df: DataFrame, by: str, order: list, value: str, before: int, after: int, min_periods: int = 1) -> DataFrame:
    w = W.partitionBy(by).orderBy(*order).rowsBetween(-before, after)
    enough = F.count(value).over(w) >= min_periods
    return df.withColumns({"rolling_min": F.when(enough, F.min(value).over(w)), "rolling_max": F.when(enough, F.max(value).over(w)), "rolling_n": F.count(value).over(w)})


def merge_product(photons: DataFrame, product: DataFrame, keys: list[str], cls: str, new: str) -> DataFrame:
    """Left join of a product; its class wins where there is one."""
    return photons.join(product, keys, "left").withColumn(cls, F.coalesce(F.col(new), F.col(cls))).drop(new)


def lake_depth(df: DataFrame, lake: str, distance: str, depth_max: str) -> DataFrame:
    far = F.max(distance).over(W.partitionBy(lake))
    return df.withColumn("depth", F.col(depth_max) * F.col(distance) / F.nullif(far, F.lit(0)))
