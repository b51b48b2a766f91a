"""Boxes as tables: chunks, tiles, windows and their halos, joined by key and never listed on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Region


def _pairs(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    return spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"))


def chunks(spark: SparkSession, region: Region, inc: float, n: int) -> DataFrame:
    """(i, j, xmin, xmax, ymin, ymax): boxes of n x n cells of ``inc`` from the lower left, cut at the region's upper edges."""
    count = lambda lo, hi: max(1, math.ceil(math.floor((hi - lo) / inc + 0.5) / n))
    t = _pairs(spark, count(region.xmin, region.xmax), count(region.ymin, region.ymax))
    at = lambda c, lo, hi: F.least(F.lit(float(hi)), F.lit(float(lo)) + c * (n * inc))
    return t.select("i", "j", at(F.col("i"), region.xmin, region.xmax).alias("xmin"), at(F.col("i") + 1, region.xmin, region.xmax).alias("xmax"), at(F.col("j"), region.ymin, region.ymax).alias("ymin"), at(F.col("j") + 1, region.ymin, region.ymax).alias("ymax"))


def tiles(spark: SparkSession, region: Region, size: float) -> DataFrame:
    """(xmin, xmax, ymin, ymax): whole tiles that cover the region."""
    count = lambda lo, hi: math.ceil((hi - lo) / size - 1e-9)
    t = _pairs(spark, count(region.xmin, region.xmax), count(region.ymin, region.ymax))
    return t.select(*((F.lit(float(lo)) + (F.col(c) + k) * size).alias(n) for lo, c, k, n in ((region.xmin, "i", 0, "xmin"), (region.xmin, "i", 1, "xmax"), (region.ymin, "j", 0, "ymin"), (region.ymin, "j", 1, "ymax"))))


def quarter_tile(x: Column, y: Column) -> list[Column]:
    """Quarter-degree bounds around a point; of no width where it lies on an edge."""
    return [F.floor(x * 4) / 4, F.ceil(x * 4) / 4, F.floor(y * 4) / 4, F.ceil(y * 4) / 4]


def centred_tile(x: Column, y: Column, half: float = 0.125) -> list[Column]:
    return [x - half, x + half, y - half, y + half]


def dense_edges(boxes: DataFrame, per_edge: int = 20) -> DataFrame:
    """(..., x, y): points along the four edges of each box, so many an edge, corners once."""
    f = F.explode(F.sequence(F.lit(0), F.lit(4 * per_edge - 1)))
    t = boxes.withColumn("__k", f).withColumn("__e", F.floor(F.col("__k") / per_edge)).withColumn("__t", (F.col("__k") % per_edge) / float(per_edge))
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    e, s = F.col("__e"), F.col("__t")
    x = F.when(e == 0, F.col("xmin")).when(e == 1, F.col("xmin") + w * s).when(e == 2, F.col("xmax")).otherwise(F.col("xmax") - w * s)
    y = F.when(e == 0, F.col("ymin") + h * s).when(e == 1, F.col("ymax")).when(e == 2, F.col("ymax") - h * s).otherwise(F.col("ymin"))
    return t.withColumns({"x": x, "y": y}).drop("__k", "__e", "__t")


def windows(spark: SparkSession, ny: int, nx: int, n: int, halo: int = 0) -> DataFrame:
    """(wr, wc, row0, row1, col0, col1): windows of n x n cells, the last row and column exclusive; with the halo, cut at the raster's edges."""
    t = _pairs(spark, math.ceil(ny / n), math.ceil(nx / n))
    lo = lambda c: F.greatest(F.lit(0), c * n - halo)
    hi = lambda c, size: F.least(F.lit(size), (c + 1) * n + halo)
    return t.select(F.col("i").alias("wr"), F.col("j").alias("wc"), lo(F.col("i")).alias("row0"), hi(F.col("i"), ny).alias("row1"), lo(F.col("j")).alias("col0"), hi(F.col("j"), nx).alias("col1"))


def in_windows(cells: DataFrame, n: int, halo: int = 0) -> DataFrame:
    """Cells with the windows (wr, wc) that they are in, in the halo too; ``inner`` tells a window's own cells."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / n), F.floor((F.col(c) + halo) / n)))
    own = (F.col("wr") == F.floor(F.col("row") / n)) & (F.col("wc") == F.floor(F.col("col") / n))
    return cells.withColumn("wr", near("row")).withColumn("wc", near("col")).withColumn("inner", own)
