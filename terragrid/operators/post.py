"""What is done to an interpolated surface, in a fixed order, and surfaces from coarse to fine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle
from . import grid as G
from . import gridding, voids


def process(cells: DataFrame, data: DataFrame, ny: int, nx: int, proximity_limit: float | None = None, size_limit: float | None = None, percentile_limit: float | None = None, expand_limit: int | None = None, filters: list[str] = (), sample: int | None = None, lower: float | None = None, upper: float | None = None, flatten: bool = False) -> DataFrame:
    """(row, col, z): interpolation limits (distance to data, size of the void, percentile of sizes, closing of the data),
    then grid filters by module strings, a finer sampling, bounds of z, and at last the voids flattened."""
    out = cells.select("row", "col", "z")
    if proximity_limit is not None:
        near = gridding.proximity(out, data).where(F.col("distance") < proximity_limit).select("row", "col")
        out = out.join(near, ["row", "col"], "left_semi")
    if size_limit is not None:
        out = voids.size_limit(out, data, ny, nx, size_limit)
    if percentile_limit is not None:
        out = voids.percentile_limit(out, data, ny, nx, percentile_limit)
    if expand_limit is not None:
        out = G.expand_limit(out, data, expand_limit)
    for text in filters:
        out = settle(G.FILTERS.apply(out, text), "filtered")
    if sample:
        out, ny, nx = voids.bilinear(out, sample), ny * sample, nx * sample
    out = G.clamp(out, lower, upper)
    return voids.flatten(out, ny, nx) if flatten else out


def coarse_to_fine(data: DataFrame, ny: int, nx: int, factors: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """(row, col, z, factor): each cell of the grid from the finest level that has data for it; factor 1 is its own.

    A level is the mean of the data in blocks of ``factor`` cells; blocks are joined by their keys.
    """
    d = data.where("z is not null").select("row", "col", "z")
    out = gridding.targets(data.sparkSession, ny, nx).join(d, ["row", "col"], "left").withColumn("factor", F.when(F.col("z").isNotNull(), 1))
    for f in sorted(factors):
        block = G.resample(d, f).select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("z").alias("__z"))
        out = out.withColumns({"__r": F.floor(F.col("row") / f).cast("int"), "__c": F.floor(F.col("col") / f).cast("int")}).join(block, ["__r", "__c"], "left")
        out = out.withColumn("factor", F.coalesce("factor", F.when(F.col("__z").isNotNull(), f))).withColumn("z", F.coalesce("z", "__z")).drop("__r", "__c", "__z")
    return out.where("z is not null").select("row", "col", "z", "factor")
