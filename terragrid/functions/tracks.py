"""Functions along tracks and on photon segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.voids import star_components
from ..tables import settle


def fill_both(df: DataFrame, by: str, order: list, value: str) -> DataFrame:
    """Nulls take the next value along the order, then the last one before."""
    w = W.partitionBy(by).orderBy(*order)
    later = F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing))
    earlier = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(value, F.coalesce(later, earlier))


def rolling_spread(df: DataFrame, by: str, order: list, value: str, before: int, after: int, min_periods: int = 1, low: float = 0.05, high: float = 0.9) -> DataFrame:
    """Quantiles, sample deviation and mean in a centred window; null where it has too few values."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(-before, after)
    enough = F.count(value).over(w) >= min_periods
    put = lambda c: F.when(enough, c.over(w))
    return df.withColumns({"rolling_low": put(F.percentile(value, low)), "rolling_high": put(F.percentile(value, high)), "rolling_std": put(F.stddev_samp(value)), "rolling_mean": put(F.avg(value))})


def fill_gaps(df: DataFrame, by: str, order: list, value: str, reach: int = 7) -> DataFrame:
    """Nulls take the mean of the rows up to ``reach`` before and after."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(w)))


def any_in_group(df: DataFrame, by: str, condition: Column, name: str) -> DataFrame:
    """Whether some row of the group meets the condition; groups are joined back, so none is sorted."""
    some = df.groupBy(by).agg(F.bool_or(condition).alias(name))
    return df.join(some, by)


def nearshore(df: DataFrame, height_window: float = 2.5, max_roughness: float = 1.5, surf_reflectance: float | None = 0.4) -> DataFrame:
    """Class 41 for photons near zero height in calm segments, or in rough ones that are bright.

    Segments are judged by their signal photons (confidence 3 or more, class not 0): median height
    within the window, and a deviation up to 0.3, or up to ``max_roughness`` with a median
    reflectance of ``surf_reflectance`` (None: of any).
    """
    signal = df.where("confidence >= 3 and ph_h_classed <> 0")
    seg = signal.groupBy("ph_segment_id").agg(F.median("photon_height").alias("__m"), F.stddev_samp("photon_height").alias("__s"), *([] if surf_reflectance is None else [F.median("reflectance").alias("__r")]))
    rough = F.col("__s") <= max_roughness
    bright = F.lit(True) if surf_reflectance is None else F.col("__r") >= surf_reflectance
    water = seg.where((F.abs("__m") <= height_window) & ((F.col("__s") <= 0.3) | (rough & bright))).select("ph_segment_id", F.lit(True).alias("__water"))
    out = df.join(water, "ph_segment_id", "left")
    hit = F.col("__water") & (F.abs("photon_height") <= height_window) & (F.col("ph_h_classed") < 40)
    return out.withColumn("ph_h_classed", F.when(hit, 41).otherwise(F.col("ph_h_classed"))).drop("__water")


def open_ocean(df: DataFrame, ocean: Column, cls: str = "ph_h_classed", height: str = "photon_height") -> DataFrame:
    """Class 44 for photons of the ocean within 2 of zero height."""
    return df.withColumn(cls, F.when(ocean & (F.abs(height) < 2), 44).otherwise(F.col(cls)))


def classify_inside(df: DataFrame, inside: str, cls: str, new: int, excepted: tuple[int, ...] = ()) -> DataFrame:
    """A class for rows inside polygons (a column of ``inside_polygons``), other than those of excepted classes."""
    hit = F.col(inside) if not excepted else F.col(inside) & ~F.col(cls).isin(*excepted)
    return df.withColumn(cls, F.when(hit, new).otherwise(F.col(cls)))


def clusters(df: DataFrame, key: str, x: str, y: str, eps: float = 1.5, min_points: int = 10) -> DataFrame:
    """(key, cluster): density clusters; the label is the smallest key of the cluster's core points, noise has none.

    A core has ``min_points`` rows within ``eps``, itself included; cores within ``eps`` of each other are one cluster,
    other rows join the cluster of the nearest core, ties by key.  Rows of a cell of two thirds of ``eps`` are all near
    each other: where a cell has ``min_points`` they are cores without a search, and its cores are one node.  Rows
    are only searched for those in cells of fewer, so no pairs of a crowd are made; cells are joined by the places
    of their cores, and a pair of cells counts once.
    """
    side = eps / 1.5
    keyed = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    b = lambda c: F.floor(F.col(c) / side)
    own = keyed.where("x - x = 0 and y - y = 0").select("k", "x", "y", b("x").alias("bx"), b("y").alias("by"))
    own = settle(own.join(own.groupBy("bx", "by").agg(F.count("*").alias("n")), ["bx", "by"]), "points")
    d2 = F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)

    def meet(left, right, half=False):
        """Rows of ``left`` with those of ``right`` (nx, ny) within eps, from cells up to two away; half: one of two cells meets the other, none itself."""
        steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if not half or (i, j) > (0, 0)))
        sent = left.withColumn("o", F.explode(steps)).withColumns({"mx": F.col("bx") + F.col("o.i"), "my": F.col("by") + F.col("o.j")}).drop("o")
        return sent.join(right, ["mx", "my"]).withColumn("d2", d2).where(F.col("d2") <= eps * eps)

    others = lambda df, *more: df.select(F.col("bx").alias("mx"), F.col("by").alias("my"), F.col("x").alias("nx"), F.col("y").alias("ny"), *more)
    few = own.where(F.col("n") < min_points)
    found = meet(few, others(own)).groupBy("k", "x", "y", "bx", "by").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).drop("n")
    cores = settle(own.where(F.col("n") >= min_points).select("k", "x", "y", "bx", "by").unionByName(found), "cores")
    node = lambda p, q: F.col(p) * (1 << 32) + F.col(q)
    places = settle(cores.groupBy("x", "y", "bx", "by").agg(F.min("k").alias("k")), "places")
    edges = meet(places, others(places), True).select(node("bx", "by").alias("u"), node("mx", "my").alias("v")).distinct()
    cell = places.groupBy("bx", "by").agg(F.min("k").alias("k")).withColumn("node", node("bx", "by"))
    cell = settle(cell.join(star_components(edges), "node", "left").withColumn("label", F.coalesce("label", "node")), "cells")
    named = cores.join(cell.join(cell.groupBy("label").agg(F.min("k").alias("cluster")), "label").select("bx", "by", "cluster"), ["bx", "by"])
    near = meet(few.join(cores.select("k"), "k", "left_anti"), others(named, F.col("k").alias("nk"), "cluster"))
    out = near.groupBy("k").agg(F.min_by("cluster", F.struct("d2", "nk")).alias("cluster")).unionByName(named.select("k", "cluster"))
    return keyed.select("k").join(out, "k", "left").withColumnRenamed("k", key)
