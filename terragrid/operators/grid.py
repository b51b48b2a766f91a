"""Grid filters and analytics on sparse cells (row, col, z).

Kernels are aggregates: each cell is sent to the k x k cells it counts for, and
grouped there in one shuffle; nothing is gathered into an array, so a grid of any
size is spread over the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Registry
from ..tables import settle
from .select import percentiles

FILTERS = Registry("grid filter")


def offsets(k: int) -> Column:
    r = k // 2
    return F.explode(F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-r, r + 1) for j in range(-r, r + 1))))


def _sent(cells: DataFrame, k: int) -> DataFrame:
    """(row, col, nz, dr, dc, cell): each value at the k x k cells it counts for; its own columns at its own place."""
    own = (F.col("o.dr") == 0) & (F.col("o.dc") == 0)
    sent = cells.select(F.struct(*(F.col(f"`{c}`") for c in cells.columns)).alias("cell"), offsets(k).alias("o")).where(F.col("cell.z").isNotNull() | own)
    return sent.select((F.col("cell.row") + F.col("o.dr")).alias("row"), (F.col("cell.col") + F.col("o.dc")).alias("col"), F.col("cell.z").alias("nz"), (-F.col("o.dr")).alias("dr"), (-F.col("o.dc")).alias("dc"), F.when(own, F.col("cell")).alias("cell"))


def focal(cells: DataFrame, k: int, **aggs: Column) -> DataFrame:
    """Cells with aggregates of their k x k neighbourhood (nz, dr, dc; nulls are no values): one shuffle, combined before it."""
    g = _sent(cells, k).groupBy("row", "col").agg(F.max("cell").alias("cell"), *(c.alias(n) for n, c in aggs.items()))
    return g.where("cell is not null").select("cell.*", *aggs)


def _with_z(df: DataFrame, z: Column, cells: DataFrame) -> DataFrame:
    return df.withColumn("z", z).select(*cells.columns)


@FILTERS.add("blur")
def blur(cells: DataFrame, blur_factor: int = 1) -> DataFrame:
    """Gaussian weights exp(-(dx^2 + dy^2) / size), over the cells that have values."""
    g = F.exp(-(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) / float(blur_factor))
    f = focal(cells, 2 * blur_factor + 1, __z=F.sum(g * F.col("nz")) / F.sum(F.when(F.col("nz").isNotNull(), g)))
    return _with_z(f, F.when(F.col("z").isNotNull(), F.col("__z")), cells)


@FILTERS.add("denoise")
def denoise(cells: DataFrame, kernel_size: int = 3) -> DataFrame:
    return _with_z(focal(cells, kernel_size, __z=F.median("nz")), F.when(F.col("z").isNotNull(), F.col("__z")), cells)


@FILTERS.add("morphology")
def morphology(cells: DataFrame, operation: str = "erosion", kernel_size: int = 3) -> DataFrame:
    """Flat grey morphology."""
    if operation in ("opening", "closing"):
        a, b = ("erosion", "dilation") if operation == "opening" else ("dilation", "erosion")
        return morphology(morphology(cells, a, kernel_size), b, kernel_size)
    f = focal(cells, kernel_size, __z=(F.min if operation == "erosion" else F.max)("nz"))
    return _with_z(f, F.when(F.col("z").isNotNull(), F.col("__z")), cells)


@FILTERS.add("hydro")
def hydro(cells: DataFrame) -> DataFrame:
    return morphology(cells, "closing", 3)


@FILTERS.add("zscore")
def zscore(cells: DataFrame, threshold: float = 3, kernel_size: int = 5) -> DataFrame:
    f = focal(cells, kernel_size, __m=F.avg("nz"), __s=F.stddev_pop("nz"))
    score = F.abs(F.col("z") - F.col("__m")) / F.greatest(F.col("__s"), F.lit(1e-6))
    return _with_z(f, F.when(score <= threshold, F.col("z")), cells)


@FILTERS.add("flats")
def flats(cells: DataFrame, size_threshold: int = 100, n_chunk: int | None = None) -> DataFrame:
    """z is dropped where more cells than the threshold have it, in the grid or in each chunk.

    Only the frequent values are joined, by their number; no window gathers the cells of one value.
    """
    keys = [F.col("z").alias("__k0")] + ([] if n_chunk is None else [F.floor(F.col("row") / n_chunk).alias("__k1"), F.floor(F.col("col") / n_chunk).alias("__k2")])
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = cells.select("*", *keys)
    frequent = keyed.where("z is not null").groupBy(*names).agg(F.count("*").alias("__n")).where(F.col("__n") > size_threshold)
    return _with_z(keyed.join(frequent, names, "left"), F.when(F.col("__n").isNull(), F.col("z")), cells)


def gradients(cells: DataFrame) -> DataFrame:
    """Cells with gr, gc: central differences per cell, one-sided where a neighbour is missing."""
    def side(line, at):
        w = W.partitionBy(line).orderBy(at)
        prev = F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag("z").over(w))
        following = F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead("z").over(w))
        return F.coalesce((following - prev) / 2, following - F.col("z"), F.col("z") - prev, F.lit(0.0))

    return cells.withColumns({"gr": side("col", "row"), "gc": side("row", "col")})


def terrain(cells: DataFrame) -> DataFrame:
    """Cells with slope, roughness, tpi and tri of 3 x 3 neighbourhoods."""
    f = focal(gradients(cells), 3, __max=F.max("nz"), __min=F.min("nz"), __sum=F.sum("nz"), __n=F.count("nz"), __sq=F.sum(F.col("nz") * F.col("nz")))
    others = F.nullif(F.col("__n") - 1, F.lit(0))
    tri = F.col("__sq") - 2 * F.col("z") * F.col("__sum") + F.col("__n") * F.col("z") * F.col("z")
    return f.select(*cells.columns, F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc")).alias("slope"), (F.col("__max") - F.col("__min")).alias("roughness"), (F.col("z") - (F.col("__sum") - F.col("z")) / others).alias("tpi"), F.sqrt(F.greatest(F.lit(0.0), tri)).alias("tri"))


@FILTERS.add("slope")
def slope(cells: DataFrame, metric: str = "slope", min_val: float | None = None, max_val: float | None = None) -> DataFrame:
    t = terrain(cells)
    bad = (F.lit(False) if min_val is None else F.col(metric) < min_val) | (F.lit(False) if max_val is None else F.col(metric) > max_val)
    return _with_z(t, F.when(~F.coalesce(bad, F.lit(False)), F.col("z")), cells)


@FILTERS.add("diff")
def diff(cells: DataFrame, aux: DataFrame, diff_threshold: float | None = None, mode: str = "absolute") -> DataFrame:
    j = cells.join(aux.select("row", "col", F.col("z").alias("__a")), ["row", "col"], "left")
    d = F.col("z") - F.col("__a")
    d = d / F.when(F.col("__a") != 0, F.col("__a")) if mode == "relative" else d
    z = d if diff_threshold is None else F.when(F.coalesce(F.abs(d) <= diff_threshold, F.lit(True)), F.col("z"))
    return _with_z(j, z, cells)


def iqr_limits(df: DataFrame, value: str, p: float = 75, k: float = 1.5, lower: str = "mirrored") -> DataFrame:
    """Limits from the percentiles p and 100 - p ("mirrored") or p and p - 50 ("offset")."""
    lo, hi = percentiles(df, value, [((100 - p) if lower == "mirrored" else (p - 50)) / 100, p / 100])
    row = (None, None) if lo is None else (lo - (hi - lo) * k, hi + (hi - lo) * k)
    return df.sparkSession.createDataFrame([row], "lower double, upper double")


@FILTERS.add("outliers")
def outliers(cells: DataFrame, percentile: float = 75, k: float = 1.5) -> DataFrame:
    """Cells whose accumulated score is an outlier itself.

    For each of z, slope, roughness and TRI a cell beyond an interquartile limit scores how far beyond it
    lies, as a share of the distance from the limit to the extreme; cells whose scores add up to more than the
    upper limit of all scores above zero go.
    """
    t = settle(terrain(cells), "terrain")
    metrics = ("z", "slope", "roughness", "tri")
    ends = t.agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("min", F.min), ("max", F.max)))).first()
    score = F.lit(0.0)
    for m in metrics:
        lim = iqr_limits(t, m, percentile, k).first()
        if lim.lower is None:
            continue
        top, low = ends[f"{m}_max"], ends[f"{m}_min"]
        over = F.when(F.col(m) > lim.upper, (F.col(m) - lim.upper) / (top - lim.upper) if top > lim.upper else F.lit(0.0))
        under = F.when(F.col(m) < lim.lower, (lim.lower - F.col(m)) / (lim.lower - low) if low < lim.lower else F.lit(0.0))
        score = score + F.coalesce(over, under, F.lit(0.0))
    t = t.withColumn("__score", score)
    cut = iqr_limits(t.where("__score > 0"), "__score", percentile, k).first().upper
    return _with_z(t, F.col("z") if cut is None else F.when(F.col("__score") <= cut, F.col("z")), cells)


@FILTERS.add("weights")
def weights(cells: DataFrame, weight_threshold: float = 1, buffer_cells: int = 1) -> DataFrame:
    """Low-weight cells within the buffer of a high-weight cell are dropped."""
    high = cells.where(F.col("weights") >= weight_threshold).select("row", "col", offsets(2 * buffer_cells + 1).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()
    low = cells.where(F.col("weights") < weight_threshold).join(high, ["row", "col"], "left_anti")
    return cells.where(F.col("weights") >= weight_threshold).unionByName(low.select(*cells.columns))


@FILTERS.add("cut")
def cut(cells: DataFrame, row0: int, row1: int, col0: int, col1: int, invert: bool = False) -> DataFrame:
    inside = F.col("row").between(row0, row1) & F.col("col").between(col0, col1)
    return cells.where(~inside if invert else inside)


@FILTERS.add("clamp")
def clamp(cells: DataFrame, lower: float | None = None, upper: float | None = None) -> DataFrame:
    z = F.col("z")
    z = z if lower is None else F.greatest(z, F.lit(float(lower)))
    return cells.withColumn("z", z if upper is None else F.least(z, F.lit(float(upper))))


def filter_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    j = before.select("row", "col", F.col("z").alias("a")).join(after.select("row", "col", F.col("z").alias("b")), ["row", "col"], "full_outer")
    removed, both = F.col("a").isNotNull() & F.col("b").isNull(), F.col("a").isNotNull() & F.col("b").isNotNull()
    d = F.when(both & (F.col("a") != F.col("b")), F.col("b") - F.col("a"))
    return j.agg(F.count("a").alias("cells"), F.sum(removed.cast("long")).alias("removed"), F.count(d).alias("changed"), F.min(d).alias("min_diff"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"))


def resample(cells: DataFrame, factor: int, how: str = "average") -> DataFrame:
    agg = {"average": F.avg("z"), "min": F.min("z"), "max": F.max("z"), "med": F.median("z"), "sum": F.sum("z"), "Q1": F.percentile("z", 0.25), "Q3": F.percentile("z", 0.75), "mode": F.mode("z", True)}[how]
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(agg.alias("z"))


def split_by_value(cells: DataFrame, value: float) -> tuple[DataFrame, DataFrame]:
    return cells.where(F.col("z") > value), cells.where(F.col("z") < value)


def mosaic(grids: list[DataFrame]) -> DataFrame:
    """The first grid that has a value wins a cell."""
    u = None
    for i, g in enumerate(grids):
        g = g.where("z is not null").select("row", "col", "z", F.lit(i).alias("p"))
        u = g if u is None else u.unionByName(g)
    return u.groupBy("row", "col").agg(F.min_by("z", "p").alias("z"))


def expand_limit(cells: DataFrame, data: DataFrame, radius: int) -> DataFrame:
    """Cells inside the morphological closing of the data mask."""
    spread = lambda m: m.select("row", "col", offsets(2 * radius + 1).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    grown = spread(data.select("row", "col")).distinct()
    full = spread(grown).groupBy("row", "col").count().where(F.col("count") == (2 * radius + 1) ** 2)
    return cells.join(full.select("row", "col"), ["row", "col"], "left_semi")


def hillshade(cells: DataFrame, azimuth: float = 315, altitude: float = 45) -> DataFrame:
    g = gradients(cells)
    zen, az = math.radians(90 - altitude), math.radians(360 - azimuth + 90)
    s, a = F.atan(F.sqrt(F.col("gr") ** 2 + F.col("gc") ** 2)), F.atan2(F.col("gr"), -F.col("gc"))
    shade = 255 * (math.cos(zen) * F.cos(s) + math.sin(zen) * F.sin(s) * F.cos(az - a))
    return g.select("row", "col", F.greatest(F.lit(0.0), shade).alias("shade"))


def hillshade_horn(cells: DataFrame, dx: float, dy: float, azimuth: float = 315, altitude: float = 45, z_factor: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """(row, col, shade): light on a surface with Horn's gradients in the units of x and y; cells with eight neighbours only."""
    n = _sent(cells.where("z is not null").select("row", "col", "z"), 3)
    w = lambda across: 2 - F.abs(across)
    east = F.sum(F.when(F.col("dc") == 1, w(F.col("dr")) * F.col("nz")).when(F.col("dc") == -1, -w(F.col("dr")) * F.col("nz"))) / 8 / float(dx)
    north = F.sum(F.when(F.col("dr") == -1, w(F.col("dc")) * F.col("nz")).when(F.col("dr") == 1, -w(F.col("dc")) * F.col("nz"))) / 8 / float(dy)
    g = n.groupBy("row", "col").agg(east.alias("gx"), north.alias("gy"), F.count("*").alias("n")).where("n = 9")
    slope_, facing = F.atan(z_factor * F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)), F.atan2(-F.col("gy"), -F.col("gx"))
    alt, light = math.radians(altitude), math.radians((450 - azimuth) % 360)
    shade = F.greatest(F.lit(0.0), 255 * (math.sin(alt) * F.cos(slope_) + math.cos(alt) * F.sin(slope_) * F.cos(light - facing)))
    return g.select("row", "col", (shade if gamma == 1 else F.pow(shade / 255, 1 / gamma) * 255).alias("shade"))


def percentile_of_values(cells: DataFrame, p: float) -> DataFrame:
    """A percentile of the cells' values, zeros left out."""
    found = percentiles(cells.where("z <> 0"), "z", [p / 100])
    return cells.sparkSession.createDataFrame([tuple(found)], "percentile double")


def hypsometry(cells: DataFrame, bins: int, low: float, high: float, weight: str | None = None) -> DataFrame:
    """(bin, n, weight, pdf, cdf) of the values; the tables behind the shares have a row a bin."""
    b = F.least(F.lit(bins - 1), F.floor((F.col("z") - low) * bins / (high - low))).cast("int")
    h = cells.where(F.col("z").between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    every = W.partitionBy(F.lit(0))
    return h.withColumns({"pdf": F.col("n") / F.sum("n").over(every), "cdf": F.sum("n").over(every.orderBy("bin")) / F.sum("n").over(every)})


def histogram(cells: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n, cumulative): the right edge belongs to the last bin."""
    b = F.least(F.lit(bins - 1), F.floor((F.col("z") - low) * bins / (high - low))).cast("int")
    h = cells.where(F.col("z").between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("cumulative", F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("bin")))
