"""Point filters: each takes and returns a DataFrame of points (x, y, z, w, u, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Grid, Region, Registry
from ..tables import settle
from .select import percentiles

FILTERS = Registry("point filter")


def effective(df: DataFrame, weight: float = 1.0, uncertainty: float = 0.0) -> DataFrame:
    """Missing weights are 1, missing uncertainties 0; both combined with the entry's."""
    fix = lambda c, d: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(d))
    return df.withColumns({"w": fix("w", 1.0) * weight, "u": F.sqrt(F.pow(fix("u", 0.0), 2) + uncertainty**2)})


def scaled(df: DataFrame, offset: float = 0.0, scale: float = 1.0, z_scale: float = 1.0) -> DataFrame:
    return df.withColumns({"x": (F.col("x") + offset) * scale, "y": (F.col("y") + offset) * scale, "z": F.col("z") * z_scale})


def wrap_longitude(df: DataFrame) -> DataFrame:
    return df.withColumn("x", (F.col("x") + 180) % 360 - 180)


def finite(df: DataFrame) -> DataFrame:
    return df.where(F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") != float("inf")))


@FILTERS.add("region")
def in_region(df: DataFrame, region: Region | str, invert: bool = False) -> DataFrame:
    region = Region.parse(region) if isinstance(region, str) else region
    return df.where(~region.holds() if invert else region.holds())


@FILTERS.add("limits")
def limits(df: DataFrame, lower: float | None = None, upper: float | None = None) -> DataFrame:
    if lower is not None:
        df = df.where(F.col("z") >= lower)
    return df if upper is None else df.where(F.col("z") <= upper)


@FILTERS.add("rangez")
def range_z(df: DataFrame, min_z: float | None = None, max_z: float | None = None, invert: bool = False) -> DataFrame:
    inside = (F.lit(True) if min_z is None else F.col("z") >= min_z) & (F.lit(True) if max_z is None else F.col("z") <= max_z)
    return df.where(~inside if invert else inside)


def _block(res: float) -> list[Column]:
    return [F.floor(F.col("x") / res), F.floor(F.col("y") / res)]


def _one_per_block(df: DataFrame, blocks: list[Column], order: list[Column], invert: bool = False) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(*blocks).orderBy(*order, "id"))
    return df.withColumn("__rn", rn).where(F.col("__rn") > 1 if invert else F.col("__rn") == 1).drop("__rn")


def _extreme(df: DataFrame, blocks: list[Column], mode: str) -> DataFrame:
    """One row a block by min_by, which combines before the shuffle; ties go to the lowest id."""
    order = F.struct(F.col("z") if mode == "min" else -F.col("z"), F.col("id"))
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order).alias("__p")
    return df.groupBy(*(b.alias(f"__b{i}") for i, b in enumerate(blocks))).agg(row).select("__p.*")


@FILTERS.add("block_minmax")
def block_minmax(df: DataFrame, res: float = 10, mode: str = "min", invert: bool = False) -> DataFrame:
    """The lowest or highest point of each absolute block; an aggregate, unless the others are asked for."""
    if not invert:
        return _extreme(df, _block(res), mode)
    return _one_per_block(df, _block(res), [F.col("z").asc() if mode == "min" else F.col("z").desc()], invert)


@FILTERS.add("block_thin")
def block_thin(df: DataFrame, res: float = 10, mode: str = "min") -> DataFrame:
    """One point of each block counted from the extent's lower corner; mean and median: the nearest to it."""
    low = df.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    df = df.crossJoin(F.broadcast(low))  # one row
    blocks = [F.floor((F.col("x") - F.col("x0")) / res), F.floor((F.col("y") - F.col("y0")) / res)]
    if mode in ("min", "max"):
        out = _extreme(df, blocks, mode)
    else:
        mid = (F.avg if mode == "mean" else F.median)("z").over(W.partitionBy(*blocks))
        out = _one_per_block(df.withColumn("__off", F.abs(F.col("z") - mid)), blocks, [F.col("__off")]).drop("__off")
    return out.drop("x0", "y0")


@FILTERS.add("density")
def density(df: DataFrame, res: float = 10, mode: str = "random") -> DataFrame:
    """One point a block: the first by id, the middle rank by z, the nearest to the mean or to the centre."""
    blocks = _block(res)
    if mode == "median":
        rank = F.row_number().over(W.partitionBy(*blocks).orderBy("z", "id"))
        size = F.count("*").over(W.partitionBy(*blocks))
        return df.withColumns({"__r": rank, "__n": size}).where("__r - 1 = floor(__n / 2)").drop("__r", "__n")
    if mode == "mean":
        return _one_per_block(df.withColumn("__off", F.abs(F.col("z") - F.avg("z").over(W.partitionBy(*blocks)))), blocks, [F.col("__off")]).drop("__off")
    if mode == "center":
        off = F.pow(F.col("x") - (blocks[0] + 0.5) * res, 2) + F.pow(F.col("y") - (blocks[1] + 0.5) * res, 2)
        return _one_per_block(df, blocks, [off])
    return _one_per_block(df, blocks, [])


def outlier_pass(df: DataFrame, cell: list[Column], percentile: float, percentage: bool = False) -> DataFrame:
    keys = [c.alias(f"__c{i}") for i, c in enumerate(cell)]
    df = df.select("*", *keys)
    names = [f"__c{i}" for i in range(len(cell))]
    means = df.groupBy(*names).agg(F.avg("z").alias("__mean"))
    off = F.abs(F.col("z") - F.col("__mean"))
    df = settle(df.join(means, names).withColumn("__res", F.when(F.col("__mean") != 0, off / F.abs("__mean") * 100) if percentage else off).drop(*names, "__mean"), "residuals")
    cut = percentiles(df, "__res", [percentile / 100])[0]
    return (df if cut is None else df.where(F.col("__res").isNull() | (F.col("__res") <= cut))).drop("__res")


@FILTERS.add("outlierz")
def outlier_z(df: DataFrame, percentile: float = 98, max_percentile: float = 99.9, multipass: int = 4, percentage: bool = False, res: float = 50, max_res: float = 5000) -> DataFrame:
    """Passes from coarse to fine cells; in each, residuals against the cell mean above a percentile go."""
    b = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if b[0] is None:
        return df
    for i in range(multipass):
        f = i / (multipass - 1) if multipass > 1 else 1.0
        n = max(1, int(max_res + (res - max_res) * f)) if multipass > 1 else int(res)
        step = lambda lo, hi: max(hi - lo, 1e-9) / n  # noqa: B023, E731
        cell = [F.floor((F.col("x") - b[0]) / step(b[0], b[1])), F.floor((F.col("y") - b[2]) / step(b[2], b[3]))]
        df = outlier_pass(df, cell, percentile + (max_percentile - percentile) * f, percentage)
    return df


@FILTERS.add("coplanar")
def coplanar(df: DataFrame, radius: float = 10, threshold: float = 0.5, min_neighbors: int = 3) -> DataFrame:
    """Points within ``threshold`` of the least-squares plane of their neighbours within ``radius``.

    Neighbours are found by an equi-join on cells of the radius' size, nine for each point.
    """
    bx, by = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    a = df.select("id", "x", "y", "z").withColumns({"gx": F.explode(F.sequence(bx - 1, bx + 1))}).withColumn("gy", F.explode(F.sequence(by - 1, by + 1)))
    n = df.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), bx.alias("gx"), by.alias("gy"))
    dx, dy, dz = F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), F.col("nz") - F.col("z")
    near = a.join(n, ["gx", "gy"]).where(dx * dx + dy * dy <= radius * radius)
    s = near.groupBy("id").agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for k, e in {"sx": dx, "sy": dy, "sz": dz, "sxx": dx * dx, "sxy": dx * dy, "syy": dy * dy, "sxz": dx * dz, "syz": dy * dz}.items()))
    det = F.expr("n*(sxx*syy-sxy*sxy) - sx*(sx*syy-sxy*sy) + sy*(sx*sxy-sxx*sy)")
    c = F.expr("sz*(sxx*syy-sxy*sxy) - sx*(sxz*syy-sxy*syz) + sy*(sxz*sxy-sxx*syz)")
    fit = s.where(F.col("n") >= min_neighbors + 1).where((F.abs(det) > 1e-9) & (F.abs(c / F.when(F.abs(det) > 1e-9, det)) <= threshold))
    return df.join(fit.select("id"), "id", "left_semi")


def _cells(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumns({"row": grid.row(), "col": grid.col()})


@FILTERS.add("raster_mask")
def raster_mask(df: DataFrame, mask: DataFrame, grid: Grid, invert: bool = False) -> DataFrame:
    """Points on nonzero cells of the mask (row, col, z); invert: the others."""
    on = mask.where("z <> 0").select("row", "col").distinct()
    return _cells(df, grid).join(on, ["row", "col"], "left_anti" if invert else "left_semi").drop("row", "col")


@FILTERS.add("diff")
def difference(df: DataFrame, raster: DataFrame, grid: Grid, min_diff: float | None = None, max_diff: float | None = None, invert: bool = False) -> DataFrame:
    """Points whose z minus the grid's is within bounds, inclusive; points off the grid stay."""
    j = _cells(df, grid).join(raster.select("row", "col", F.col("z").alias("__ref")), ["row", "col"], "left")
    d = F.col("z") - F.col("__ref")
    inside = (F.lit(True) if min_diff is None else d >= min_diff) & (F.lit(True) if max_diff is None else d <= max_diff)
    return j.where(F.col("__ref").isNull() | (~inside if invert else inside)).drop("row", "col", "__ref")


@FILTERS.add("rq")
def reference_quality(df: DataFrame, raster: DataFrame, grid: Grid, threshold: float = 10, scaled_percentile: bool = False) -> DataFrame:
    """Points within ``threshold`` percent of a reference grid; no reference or no number: kept."""
    j = _cells(df, grid).join(raster.select("row", "col", F.col("z").alias("__ref")), ["row", "col"], "left")
    base = (F.col("z") + F.col("__ref")) if scaled_percentile else F.col("__ref")
    pct = F.when(base != 0, F.abs((F.col("z") - F.col("__ref")) / base) * 100)
    return j.where(pct.isNull() | (pct <= threshold)).drop("row", "col", "__ref")


@FILTERS.add("vector_mask")
def vector_mask(df: DataFrame, polygon: list, invert: bool = False) -> DataFrame:
    """Points inside a ring, by the even-odd rule on its edges (an expression, no join)."""
    x, y, crossings = F.col("x"), F.col("y"), F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2:
            over = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + (over & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).cast("int")
    inside = crossings % 2 == 1
    return df.where(~inside if invert else inside)


def cell_mean(df: DataFrame, grid: Grid) -> DataFrame:
    """Points with the mean of their cell; cells are grouped and joined back."""
    p = _cells(df, grid)
    return p.join(p.groupBy("row", "col").agg(F.avg("z").alias("cell_mean")), ["row", "col"])


def block_lists(df: DataFrame, grid: Grid) -> DataFrame:
    """(row, col, ids): sorted ids of the points in each cell."""
    return _cells(df, grid).groupBy("row", "col").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def decimate(df: DataFrame, max_points: int, key: str = "id", seed: int = 42) -> DataFrame:
    """At most so many points, drawn by a hash of their key: the same in every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(max_points)


def chain(df: DataFrame, filters: list[str], **more) -> DataFrame:
    for text in filters:
        df = FILTERS.apply(df, text, **more)
    return df
