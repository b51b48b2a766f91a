"""Binning of points to cells and weighted stacking of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Grid


def to_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Points with row and col; those outside the grid are dropped."""
    row, col = grid.row(), grid.col()
    return points.withColumns({"row": row, "col": col}).where(grid.inside(row, col))


def bin_points(points: DataFrame, grid: Grid, mode: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, z, x, y, weight, uncertainty, count) of each occupied cell."""
    p = to_cells(points, grid)
    one = F.count("*") == 1
    each = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median}
    if mode == "sums":
        agg = [F.sum(F.col(c) * F.col("w")).alias(c) for c in ("z", "x", "y")] + [F.sum("w").alias("weight")]
    else:
        xy = each.get(mode, F.avg) if mode in ("min", "max") else F.avg
        z = each[mode]("z") if mode in each else F.when(one, 0.0).otherwise((F.stddev_pop if mode == "std" else F.var_pop)("z"))
        agg = [z.alias("z"), xy("x").alias("x"), xy("y").alias("y"), (F.avg("w") * F.count("*")).alias("weight")]
    spread = F.var_pop("z") if mode in ("mean", "median", "sums") else F.lit(0.0)
    return p.groupBy(*by, "row", "col").agg(*agg, F.sqrt(F.pow(F.max("u"), 2) + spread).alias("uncertainty"), F.count("*").alias("count"))


def block_nodes(points: DataFrame, grid: Grid, weighted: bool = False) -> DataFrame:
    """Nearest-node means at node coordinates; points strictly inside the box only."""
    col = F.floor((F.col("x") - grid.x0) / grid.dx + 0.5).cast("int")
    row = F.floor((F.lit(grid.y0) - F.col("y")) / grid.dy + 0.5).cast("int")
    strict = (F.col("x") > grid.x0) & (F.col("x") < grid.x0 + grid.nx * grid.dx) & (F.col("y") < grid.y0) & (F.col("y") > grid.y0 - grid.ny * grid.dy)
    z = F.sum(F.col("z") * F.col("w")) / F.sum("w") if weighted else F.avg("z")
    return points.where(strict).groupBy(row.alias("row"), col.alias("col")).agg(z.alias("z"), F.count("*").alias("count"))


def source_sums(points: DataFrame, grid: Grid, source: str = "source") -> DataFrame:
    """The mergeable state of a stack: weighted sums of each source and cell."""
    p = to_cells(points, grid)
    w = F.col("w")
    return p.groupBy(source, "row", "col").agg(*(F.sum(F.col(c) * w).alias(f"s{c}") for c in "zxy"), F.sum(w).alias("sw"), F.sum(F.col("z") * F.col("z") * w).alias("szz"), F.max("u").alias("u"), F.count("*").alias("count")).withColumnRenamed(source, "source")


def merge_sums(*tables: DataFrame) -> DataFrame:
    """Sums of further data added to sums that are kept; the order doesn't matter."""
    df = tables[0]
    for t in tables[1:]:
        df = df.unionByName(t)
    return df.groupBy("source", "row", "col").agg(*(F.sum(c).alias(c) for c in ("sz", "sx", "sy", "sw", "szz")), F.max("u").alias("u"), F.sum("count").alias("count"))


def stack(sums: DataFrame, mode: str = "mean", thresholds: list[float] | None = None, min_count: int | None = None) -> DataFrame:
    """(row, col, z, x, y, weights, count, src_uncertainty, uncertainty) of each cell.

    mean, std, var, weights, sums: over all sources; min, max: the source with the
    extreme mean; supercede: the source of the highest mean weight; mixed: the mean
    of the sources in the highest band of ``thresholds`` that has any.  Ties go to
    the first source by name.
    """
    s = sums.withColumns({"zm": F.col("sz") / F.col("sw"), "wm": F.col("sw") / F.col("count")})
    if mode in ("min", "max", "supercede"):
        order = {"min": [F.col("zm").asc()], "max": [F.col("zm").desc()], "supercede": [F.col("wm").desc()]}[mode]
        s = s.withColumn("__r", F.row_number().over(W.partitionBy("row", "col").orderBy(*order, "source"))).where("__r = 1")
    elif mode == "mixed":
        band = F.lit(0)
        for t in sorted(thresholds or [1.0]):
            band = band + (F.col("wm") >= t).cast("int")
        s = s.withColumn("__band", band).withColumn("__top", F.max("__band").over(W.partitionBy("row", "col"))).where("__band = __top")
    g = s.groupBy("row", "col").agg(*(F.sum(c).alias(c) for c in ("sz", "sx", "sy", "sw", "szz", "count")), F.sum(F.col("u") * F.col("u")).alias("uu"))
    mean = F.col("sz") / F.col("sw")
    var = F.greatest(F.lit(0.0), F.col("szz") / F.col("sw") - mean * mean)
    z = {"std": F.sqrt(var), "var": var, "weights": F.col("sw"), "sums": F.col("sz")}.get(mode, mean)
    g = g if min_count is None else g.where(F.col("count") >= min_count)
    return g.select("row", "col", z.alias("z"), (F.col("sx") / F.col("sw")).alias("x"), (F.col("sy") / F.col("sw")).alias("y"), (F.col("sw") / F.col("count")).alias("weights"), "count", F.sqrt("uu").alias("src_uncertainty"), F.sqrt(F.col("uu") + var).alias("uncertainty"))


def coverage(sums: DataFrame, level: int | None = None) -> DataFrame:
    """(row, col, source): which source paths cover a cell; level > 0 trims so many parts, < 0 keeps two."""
    path = F.col("source")
    if level:
        parts = F.split(path, "/")
        path = F.array_join(F.slice(parts, 1, 2) if level < 0 else F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - level)), "/")
    return sums.select("row", "col", path.alias("source")).distinct()


def winning_source(sums: DataFrame) -> DataFrame:
    """(row, col, source): the source of the highest mean weight covers the cell, the masks of the others are reset."""
    top = F.min_by("source", F.struct(-(F.col("sw") / F.col("count")), F.col("source")))
    return sums.groupBy("row", "col").agg(top.alias("source"))


def coverage_of_valid(cover: DataFrame, cells: DataFrame) -> DataFrame:
    """Coverage where the stack has a value."""
    return cover.join(cells.where("z is not null").select("row", "col"), ["row", "col"], "left_semi")


def single_mask(cover: DataFrame) -> DataFrame:
    """(row, col, z): 1 where any source covers the cell."""
    return cover.select("row", "col").distinct().withColumn("z", F.lit(1))


def stack_points(cells: DataFrame, grid: Grid, node: bool = False) -> DataFrame:
    """Cells as points, at mean coordinates or at cell centres."""
    xy = {"x": F.col("x"), "y": F.col("y")} if node else {"x": grid.x(), "y": grid.y()}
    return cells.where("z is not null").withColumns(xy).select("x", "y", "z", F.col("weights").alias("w"), F.col("uncertainty").alias("u"))


def statistics(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("numpts"), *(f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def mini_grid(points: DataFrame, n: int = 10) -> DataFrame:
    """n x n cells over the extent: the weighted sum of z over the number of points."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda v, lo, hi: F.least(F.lit(n - 1), F.floor((F.col(v) - F.col(lo)) * n / F.nullif(F.col(hi) - F.col(lo), F.lit(0)))).cast("int")
    p = points.crossJoin(F.broadcast(b)).withColumns({"col": at("x", "x0", "x1"), "row": at("y", "y0", "y1")})  # one row
    return p.groupBy("row", "col").agg((F.sum(F.col("z") * F.col("w")) / F.count("*")).alias("z"), F.count("*").alias("count"))
