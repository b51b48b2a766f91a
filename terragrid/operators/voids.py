"""Connected areas of cells: voids, zones and their limits.

Areas are told from runs of consecutive cells in a row: a run is one node, touching
runs of neighbouring rows are an edge, so that a wide area has few nodes.  Edges
become components by large and small stars, each round a grouped minimum and a
join, written to the shared folder; nothing is gathered per area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import settle
from .gridding import targets

#: columns of a bucket in which runs of neighbouring rows are compared
SPAN = 512


def star_components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (u, v): label is the component's smallest node."""
    pairs = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = state(edges)  # of a set of edges: 128 bits
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(pairs(F.col("v"), F.col("m")), pairs(F.col("u"), F.col("m")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = settle(small, "edges")
        seen, last, edges = state(small), seen, small
        if seen == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _runs(cells: DataFrame, value: str | None) -> DataFrame:
    """(row, a, b, v): consecutive cells of a row, of equal values."""
    v = F.col(value) if value else F.lit(0)
    c = cells.select(F.col("row").cast("long"), F.col("col").cast("long"), v.alias("v")).distinct()
    line = W.partitionBy("row").orderBy("col")
    start = F.when((F.lag("col").over(line) == F.col("col") - 1) & F.lag("v").over(line).eqNullSafe(F.col("v")), 0).otherwise(1)
    c = c.withColumn("s", start).withColumn("k", F.sum("s").over(line))
    return c.groupBy("row", "k").agg(F.min("col").alias("a"), F.max("col").alias("b"), F.first("v").alias("v")).drop("k")


def _gaps(cells: DataFrame, ny: int, nx: int) -> DataFrame:
    """(row, a, b, v): runs of the grid's cells without a value, told from the values on both sides of each."""
    line = W.partitionBy("row").orderBy("col")
    c = cells.where("z is not null").select(F.col("row").cast("long"), F.col("col").cast("long")).where(F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1)).distinct()
    ends = cells.sparkSession.range(ny).select(F.col("id").alias("row"), F.lit(nx).cast("long").alias("col"))
    before = F.coalesce(F.lag("col").over(line), F.lit(-1).cast("long"))
    gaps = c.unionByName(ends).select("row", (before + 1).alias("a"), (F.col("col") - 1).alias("b"), F.lit(0).alias("v"))
    return gaps.where("a <= b")


def _spread(lo, hi):
    return F.explode(F.sequence(F.floor(lo / SPAN), F.floor(hi / SPAN))).alias("bucket")


def _touching(runs: DataFrame, d: int) -> DataFrame:
    """(u, v, shared): runs of neighbouring rows that touch, once each, with the columns that they share."""
    up = runs.select("row", F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("v").alias("v1"), F.col("node").alias("u"), _spread(F.col("a"), F.col("b")))
    down = runs.select((F.col("row") - 1).alias("row"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("v").alias("v2"), F.col("node").alias("v"), _spread(F.col("a") - d, F.col("b") + d))
    first = F.floor(F.greatest(F.col("a1"), F.col("a2") - d) / SPAN)  # the bucket in which they meet first
    shared = F.greatest(F.lit(0), F.least("b1", "b2") - F.greatest("a1", "a2") + 1)
    met = up.join(down, ["row", "bucket"]).where((F.col("bucket") == first) & (F.col("a1") <= F.col("b2") + d) & (F.col("a2") <= F.col("b1") + d) & F.col("v1").eqNullSafe(F.col("v2")))
    return met.select("u", "v", shared.alias("shared"))


def _areas(runs: DataFrame, diagonal: bool = False) -> DataFrame:
    """(row, a, b, v, node, label, size) of runs by the areas that they form."""
    runs = settle(runs.select("row", "a", "b", "v", (F.col("row") * (1 << 32) + F.col("a")).alias("node")), "runs")
    named = runs.join(star_components(_touching(runs, int(diagonal)).select("u", "v")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("label").agg(F.sum(F.col("b") - F.col("a") + 1).alias("size"))
    return named.join(sizes, "label").select("row", "a", "b", "v", "node", "label", "size")


def _cells(areas: DataFrame, *more: str) -> DataFrame:
    """(row, col, ..) of the cells of runs."""
    return areas.select(F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("col"), *more)


def connected(cells: DataFrame, diagonal: bool = False, value: str | None = None) -> DataFrame:
    """(row, col, label, size) of the areas that the cells form, of equal ``value`` if one is named.

    Cells touch at sides, at corners too if ``diagonal``.  The label is the area's first
    cell in order of rows and columns, as row * 2**32 + col.
    """
    return _cells(_areas(_runs(cells, value), diagonal), "label", "size")


def voids(cells: DataFrame, ny: int, nx: int) -> DataFrame:
    """(row, col) of the grid's cells without a value."""
    return _cells(_gaps(cells, ny, nx))


def void_runs(cells: DataFrame, ny: int, nx: int, diagonal: bool = False) -> DataFrame:
    """(row, a, b, node, label, size): the voids' runs, from column a to b."""
    return _areas(_gaps(cells, ny, nx), diagonal)


def void_areas(cells: DataFrame, ny: int, nx: int, diagonal: bool = False) -> DataFrame:
    return _cells(void_runs(cells, ny, nx, diagonal), "label", "size")


def _around(cells: DataFrame, k: int = 1) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-k, k + 1) for j in range(-k, k + 1) if i or j))
    o = cells.withColumn("o", F.explode(steps))
    return o.withColumns({"row": F.col("row") + F.col("o.dr"), "col": F.col("col") + F.col("o.dc")}).drop("o")


def borders(areas: DataFrame, cells: DataFrame) -> DataFrame:
    """(label, row, col, z): the cells with values that touch an area at a side or corner, once each.

    ``areas`` are runs: a cell meets those of its row and of both beside it.
    """
    at = cells.where("z is not null").select("row", "col", "z")
    sent = at.select(F.explode(F.array(*((F.col("row") + i).cast("long") for i in (-1, 0, 1)))).alias("near"), _spread(F.col("col") - 1, F.col("col") + 1), "row", "col", "z")
    runs = areas.select(F.col("row").alias("near"), _spread(F.col("a"), F.col("b")), "a", "b", "label")
    return sent.join(runs, ["near", "bucket"]).where("a <= col + 1 and col - 1 <= b").select("label", "row", "col", "z").distinct()


def flatten(cells: DataFrame, ny: int, nx: int, size_threshold: int = 1, percentile: float = 0.05) -> DataFrame:
    """(row, col, z): voids of so many cells or more get a low percentile of the cells around them."""
    areas = settle(void_runs(cells, ny, nx).where(F.col("size") >= size_threshold), "areas")
    level = borders(areas, cells).groupBy("label").agg(F.percentile("z", percentile).alias("z"))
    return cells.where("z is not null").select("row", "col", "z").unionByName(_cells(areas.join(level, "label"), "z"))


def size_limit(filled: DataFrame, data: DataFrame, ny: int, nx: int, limit: float) -> DataFrame:
    """The filled cells without those in voids of the data that have ``limit`` cells or more."""
    large = void_areas(data, ny, nx).where(F.col("size") >= limit).select("row", "col")
    return filled.join(large, ["row", "col"], "left_anti")


def percentile_limit(filled: DataFrame, data: DataFrame, ny: int, nx: int, percentile: float) -> DataFrame:
    """``size_limit`` at a percentile of the sizes of the voids."""
    areas = settle(void_runs(data, ny, nx), "areas")
    cut = areas.select("label", "size").distinct().agg(F.percentile("size", percentile / 100).alias("cut"))
    large = _cells(areas.crossJoin(F.broadcast(cut)).where("size >= cut"))  # one row
    return filled.join(large, ["row", "col"], "left_anti")


def weight_zones(cells: DataFrame, weight_threshold: float = 1, size_threshold: int = 10) -> DataFrame:
    """Cells with z null where a connected zone of high weights is smaller than the threshold."""
    zones = connected(cells.where(F.col("weights") >= weight_threshold)).where(F.col("size") < size_threshold).select("row", "col", F.lit(True).alias("small"))
    return cells.join(zones, ["row", "col"], "left").withColumn("z", F.when(F.col("small").isNull(), F.col("z"))).select(*cells.columns)


def shapes(areas: DataFrame, cells: DataFrame) -> DataFrame:
    """(label, size, perimeter, circularity, border_std): sides that an area has to the outside, 4 pi A / P^2, and the spread of the cells around it.

    ``areas`` are runs: each has two ends and two long sides, less twice what it shares with a run below.
    """
    shared = _touching(areas.withColumn("v", F.lit(0)), 0).groupBy(F.col("u").alias("node")).agg(F.sum("shared").alias("shared"))
    long, sides = F.col("b") - F.col("a") + 1, F.coalesce("shared", F.lit(0))
    base = areas.join(shared, "node", "left").groupBy("label").agg(F.sum(long).alias("size"), F.sum(2 + 2 * long - 2 * sides).alias("perimeter"))
    spread = borders(areas, cells).groupBy("label").agg(F.stddev_pop("z").alias("border_std"))
    return base.join(spread, "label", "left").withColumn("circularity", 4 * F.pi() * F.col("size") / F.pow("perimeter", 2)).select("label", "size", "perimeter", "circularity", "border_std")


def rivers(cells: DataFrame, ny: int, nx: int, size_threshold: int = 100, max_circularity: float = 0.25) -> DataFrame:
    """Shapes of voids that are long and thin."""
    areas = settle(void_runs(cells, ny, nx).where(F.col("size") >= size_threshold), "areas")
    return shapes(areas, cells).where(F.col("circularity") <= max_circularity)


def count_limit(cells: DataFrame, limit: float, column: str = "count") -> DataFrame:
    """z only where the count (or another column) is above the limit."""
    return cells.withColumn("z", F.when(F.col(column) > limit, F.col("z")))


def crop(cells: DataFrame) -> DataFrame:
    """The cells with values, counted from their first row and column."""
    c = cells.where("z is not null")
    low = c.agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
    return c.crossJoin(F.broadcast(low)).withColumns({"row": F.col("row") - F.col("r0"), "col": F.col("col") - F.col("c0")}).drop("r0", "c0")  # one row


def bilinear(cells: DataFrame, factor: int) -> DataFrame:
    """(row, col, z) of a grid of ``factor`` times the rows and columns: of the four cell centres around each new centre,
    those with values, by their bilinear weights."""
    c = cells.where("z is not null").select("row", "col", "z")
    new = F.explode(F.sequence(F.lit(-factor), F.lit(2 * factor - 1)))
    at = lambda new_, old: (new_ + 0.5) / factor - 0.5 - old
    sent = c.select("row", "col", "z", new.alias("i")).select("*", new.alias("j"))
    sent = sent.select((F.col("row") * factor + F.col("i")).alias("r"), (F.col("col") * factor + F.col("j")).alias("c"), "row", "col", "z")
    w = (1 - F.abs(at(F.col("r"), F.col("row")))) * (1 - F.abs(at(F.col("c"), F.col("col"))))
    near = sent.where((F.abs(at(F.col("r"), F.col("row"))) < 1) & (F.abs(at(F.col("c"), F.col("col"))) < 1)).withColumn("w", w)
    inside = c.select("row", "col").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).select((F.col("row") * factor + F.col("i")).alias("row"), (F.col("col") * factor + F.col("j")).alias("col"))
    mean = near.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))
    return mean.join(inside, ["row", "col"], "left_semi")


def blend(high: DataFrame, low: DataFrame, buffer_cells: int = 1) -> DataFrame:
    """(row, col, z): high-weight cells as they are; low-weight cells within the buffer of one are mixed with the nearest
    high cell's z, the less the further; the others as they are."""
    r = buffer_cells
    sent = _around(high.select("row", "col", F.col("row").alias("hr"), F.col("col").alias("hc"), F.col("z").alias("hz")), r)
    d2 = F.pow(F.col("row") - F.col("hr"), 2) + F.pow(F.col("col") - F.col("hc"), 2)
    near = sent.groupBy("row", "col").agg(F.min_by(F.struct(F.sqrt(d2).alias("d"), F.col("hz").alias("z")), F.struct(d2, "hr", "hc")).alias("h"))
    share = F.least(F.lit(1.0), F.col("h.d") / (r + 1))
    mixed = low.join(high.select("row", "col"), ["row", "col"], "left_anti").join(near, ["row", "col"], "left")
    z = F.when(F.col("h").isNull(), F.col("z")).otherwise(F.col("z") * share + F.col("h.z") * (1 - share))
    return high.select("row", "col", "z").unionByName(mixed.select("row", "col", z.alias("z")))


def edges_of(rings: list[list[tuple[float, float]]]) -> list[tuple[float, float, float, float]]:
    """Edges of outer rings and holes alike."""
    return [(*map(float, a), *map(float, b)) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a[1] != b[1]]


def inside_polygons(df: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", band: float = 1.0) -> DataFrame:
    """``df`` with ``inside``: whether an odd number of the edges (x1, y1, x2, y2) lies to the right of the point.

    Holes need no rule of their own.  Points and edges meet in bands of y, so a polygon of
    any number of edges is a join and not an expression.
    """
    key = df.withColumn("__id", F.monotonically_increasing_id())
    key = settle(key, "points")
    e = edges.select("x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band))).alias("__band"))
    p = key.select("__id", F.col(x).alias("px"), F.col(y).alias("py"), F.floor(F.col(y) / band).alias("__band"))
    crossed = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = p.join(e, "__band").where(crossed).groupBy("__id").agg((F.count("*") % 2 == 1).alias("inside"))
    return key.join(hits, "__id", "left").withColumn("inside", F.coalesce("inside", F.lit(False))).drop("__id")


def clip(cells: DataFrame, edges: DataFrame, grid, invert: bool = False, band: float = 1.0) -> DataFrame:
    """The cells whose centres lie in the polygons."""
    at = cells.withColumns({"__x": grid.x(), "__y": grid.y()})
    got = inside_polygons(at, edges, "__x", "__y", band)
    return got.where(~F.col("inside") if invert else F.col("inside")).select(*cells.columns)


def rasterise(spark, edges: DataFrame, grid, band: float = 1.0) -> DataFrame:
    """(row, col, z): 1 where the cell's centre lies in the polygons, 0 elsewhere."""
    at = targets(spark, grid.ny, grid.nx).withColumns({"__x": grid.x(), "__y": grid.y()})
    return inside_polygons(at, edges, "__x", "__y", band).select("row", "col", F.col("inside").cast("int").alias("z"))


def fill(cells: DataFrame, ny: int, nx: int, method: str = "idw", max_dist: int = 100, k: int = 8) -> DataFrame:
    """Voids filled from the cells within ``max_dist``."""
    from . import gridding

    gaps = voids(cells, ny, nx)
    how = gridding.idw(gaps, cells, 1, k, max_dist) if method == "idw" else gridding.nearest(gaps, cells, max_dist)
    return cells.where("z is not null").select("row", "col", "z").unionByName(how.select("row", "col", "z"))
