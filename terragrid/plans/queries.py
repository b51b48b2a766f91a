"""Queries over the driver's tables, each with its SQL.

Points: x = l_partkey, y = l_suppkey, z = l_quantity, w = 1 + 100 l_discount, u =
100 l_tax (whole numbers, so that sums are exact in any order), source from the
flags, id from a hash-free total order of all columns.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, sensor
from ..model import Grid, Region
from ..operators import grid as G
from ..operators import gridding as I
from ..operators import points as P
from ..operators import stack as S
from ..streaming import stack as stream
from ..tables import shared_dir

#: cell sizes; the grid's extent is that of the points
DX, DY = 50, 10

PTS = """select cast(l_partkey as double) x, cast(l_suppkey as double) y, l_quantity z,
 1 + round(100 * l_discount) w, round(100 * l_tax) u, l_returnflag || '/' || l_linestatus source,
 l_orderkey * 1000000 + l_linenumber * 100000 + cast(l_quantity as bigint) * 1000 + cast(round(100 * l_discount) as bigint) * 10 + cast(round(100 * l_tax) as bigint) id
 from lineitem"""
EXTENT = "e as (select (floor(max(x) / 50) + 1) * 50 x1, ceil(max(y) / 10) * 10 y1, ceil(min(y) / 10) * 10 - 10 y0 from pts)"
BINNED = f"pts as ({PTS}), {EXTENT}, c as (select pts.*, cast(floor(x / 50.0) as int) col, cast(floor((y1 - y) / 10.0) as int) row from pts, e)"
STACKED = f"{BINNED}, s as (select source, row, col, sum(z*w) sz, sum(x*w) sx, sum(y*w) sy, sum(w) sw, sum(z*z*w) szz, max(u) u, count(*) n from c group by all)"
MEAN = f"{STACKED}, g as (select row, col, floor(sum(sz)/sum(sw)) z, sum(sw) sw, sum(n) n from s group by row, col)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    return as_points(table(spark, d, "lineitem"))


def as_points(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "cast(l_partkey as double) x", "cast(l_suppkey as double) y", "l_quantity z", "1 + round(100 * l_discount) w", "round(100 * l_tax) u", "concat(l_returnflag, '/', l_linestatus) source",
        "l_orderkey * 1000000 + l_linenumber * 100000 + cast(l_quantity as bigint) * 1000 + cast(round(100 * l_discount) as bigint) * 10 + cast(round(100 * l_tax) as bigint) id",
    )


def cells_of(spark: SparkSession, d: str) -> Grid:
    """Cells around all coordinates, at any size of the table; a point on a cell's upper edge belongs to it."""
    x, y, low = points(spark, d).agg(F.max("x"), F.max("y"), F.min("y")).first()
    up = lambda v: math.ceil((v or 0) / DY) * DY
    return Grid.of(Region(0, ((x or 0) // DX + 1) * DX, up(low) - DY, up(y)), DX, DY)


def sums(spark: SparkSession, d: str) -> DataFrame:
    return S.source_sums(points(spark, d), cells_of(spark, d))


def surface(spark: SparkSession, d: str) -> DataFrame:
    """Whole-number mean surface, the input of the grid filters."""
    return S.stack(sums(spark, d)).select("row", "col", F.floor("z").cast("double").alias("z"))


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


XYZ = "cast(x as bigint) x, cast(y as bigint) y, cast(z as bigint) z"


def xyz(df: DataFrame) -> DataFrame:
    return df.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"))


@query(f"with pts as ({PTS}) select {XYZ} from pts where x between 100 and 900 and y between 20 and 80 and z between 5 and 40")
def points_region(s, d):
    return xyz(P.in_region(points(s, d), Region(100, 900, 20, 80, 5, 40)))


@query(f"with pts as ({PTS}) select {XYZ} from pts where not (x between 100 and 900 and y between 20 and 80)")
def points_region_inverted(s, d):
    return xyz(P.in_region(points(s, d), "100/900/20/80", invert=True))


@query(f"with pts as ({PTS}) select {XYZ} from pts where z >= 10 and z <= 30")
def points_limits(s, d):
    return xyz(P.chain(points(s, d), ["limits:lower=10:upper=30"]))


@query(f"with pts as ({PTS}) select {XYZ} from pts where not (z >= 10 and z <= 30)")
def points_rangez_inverted(s, d):
    return xyz(P.chain(points(s, d), ["rangez:min_z=10:max_z=30:invert=true"]))


@query(f"with pts as ({PTS}) select cast(((x + 180) % 360 - 180) as bigint) x, cast(sum(z) as bigint) z from pts group by 1")
def points_longitude_wrap(s, d):
    return P.wrap_longitude(points(s, d)).groupBy(F.col("x").cast("long").alias("x")).agg(F.sum("z").cast("long").alias("z"))


@query(f"with pts as ({PTS}), r as (select *, row_number() over (partition by floor(x/50), floor(y/50) order by z, id) k from pts) select floor(x/50)::bigint bx, floor(y/50)::bigint \"by\", cast(z as bigint) z from r where k = 1")
def points_block_min(s, d):
    return P.block_minmax(points(s, d), 50, "min").select(F.floor(F.col("x") / 50).alias("bx"), F.floor(F.col("y") / 50).alias("by"), F.col("z").cast("long").alias("z"))


@query(f"with pts as ({PTS}), m as (select min(x) x0, min(y) y0 from pts), r as (select floor((x-x0)/50)::bigint bx, floor((y-y0)/50)::bigint b_y, z from pts, m) select bx, b_y, cast(max(z) as bigint) z from r group by 1, 2")
def points_block_thin_max(s, d):
    p = points(s, d)
    low = p.agg(F.min("x").alias("a"), F.min("y").alias("b"))
    return P.block_thin(p, 50, "max").crossJoin(F.broadcast(low)).select(F.floor((F.col("x") - F.col("a")) / 50).alias("bx"), F.floor((F.col("y") - F.col("b")) / 50).alias("b_y"), F.col("z").cast("long").alias("z"))


@query(f"with pts as ({PTS}), r as (select *, row_number() over (partition by floor(x/50), floor(y/50) order by z, id) k, count(*) over (partition by floor(x/50), floor(y/50)) n from pts) select floor(x/50)::bigint bx, floor(y/50)::bigint b_y, cast(z as bigint) z from r where k - 1 = n // 2")
def points_density_median(s, d):
    return P.density(points(s, d), 50, "median").select(F.floor(F.col("x") / 50).alias("bx"), F.floor(F.col("y") / 50).alias("b_y"), F.col("z").cast("long").alias("z"))


@query(f"with pts as ({PTS}), r as (select *, abs(z - avg(z) over (partition by floor(x/100), floor(y/100))) res from pts), t as (select quantile_cont(res, 0.98) c from r) select count(*) n, cast(sum(z) as bigint) z from r, t where round(res, 9) <= round(c, 9)")
def points_outlier_pass(s, d):
    p = P.outlier_pass(points(s, d), [F.floor(F.col("x") / 100), F.floor(F.col("y") / 100)], 98)
    return p.agg(F.count("*").alias("n"), F.sum("z").cast("long").alias("z"))


def _outlier_passes(res: int = 20, max_res: int = 200, p: float = 98, max_p: float = 99.9, passes: int = 4) -> str:
    """SQL of the passes from coarse to fine cells."""
    sql, last = f"with p0 as ({PTS}), m as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from p0)", "p0"
    for i in range(passes):
        f = i / (passes - 1)
        n, q = max(1, int(max_res + (res - max_res) * f)), (p + (max_p - p) * f) / 100
        sql += f", a{i} as (select t.*, abs(z - avg(z) over (partition by floor((x - x0) / ((x1 - x0) / {n})), floor((y - y0) / ((y1 - y0) / {n})))) e from (select x, y, z from {last}) t, m), c{i} as (select quantile_cont(e, {q!r}) c from a{i}), p{i + 1} as (select x, y, z from a{i}, c{i} where e <= c)"
        last = f"p{i + 1}"
    return f"{sql} select {XYZ} from {last}"


@query(_outlier_passes())
def points_outlierz(s, d):
    return xyz(P.chain(points(s, d), ["outlierz:res=20:max_res=200"]))


@query(f"with pts as ({PTS}) select {XYZ} from pts where x + y < 1000 and x > 0 and y > 0")
def points_polygon(s, d):
    return xyz(P.vector_mask(points(s, d), [(0, 0), (1000, 0), (0, 1000)]).where("x > 0 and y > 0"))


@query(f"with {BINNED}, m as (select row, col from c group by 1, 2 having avg(z) > 25) select {XYZ} from c semi join m using (row, col)")
def points_raster_mask(s, d):
    grid = cells_of(s, d)
    p = S.to_cells(points(s, d), grid)
    mask = p.groupBy("row", "col").agg((F.avg("z") > 25).cast("int").alias("z"))
    return xyz(P.raster_mask(p.drop("row", "col"), mask, grid))


@query(f"with {BINNED}, m as (select row, col, floor(avg(z)) r from c group by 1, 2) select {XYZ} from c join m using (row, col) where z - r between -5 and 5")
def points_diff(s, d):
    grid = cells_of(s, d)
    p = S.to_cells(points(s, d), grid)
    ref = p.groupBy("row", "col").agg(F.floor(F.avg("z")).cast("double").alias("z"))
    return xyz(P.difference(p.drop("row", "col"), ref, grid, -5, 5))


@query(f"with {BINNED}, m as (select row, col, floor(avg(z)) r from c group by 1, 2) select {XYZ} from c join m using (row, col) where r = 0 or abs(z - r) / r * 100 <= 10")
def points_reference_quality(s, d):
    grid = cells_of(s, d)
    p = S.to_cells(points(s, d), grid)
    ref = p.groupBy("row", "col").agg(F.floor(F.avg("z")).cast("double").alias("z"))
    return xyz(P.reference_quality(p.drop("row", "col"), ref, grid, 10))


for _mode, _agg in (("mean", "sum(z) / count(*)"), ("min", "min(z)"), ("max", "max(z)"), ("median", "median(z)"), ("sums", "sum(z * w)")):

    def _bin(s, d, mode=_mode):
        return S.bin_points(points(s, d), cells_of(s, d), mode).select("row", "col", "z", "count")

    QUERIES[f"bin_{_mode}"] = lambda s, d, f=_bin: f(s, d)
    ORACLE[f"bin_{_mode}"] = f'with {BINNED} select row, col, {_agg} z, count(*) "count" from c group by row, col'

for _mode, _agg in (("std", "stddev_pop(z)"), ("var", "var_pop(z)")):

    def _bin2(s, d, mode=_mode):
        return S.bin_points(points(s, d), cells_of(s, d), mode).select("row", "col", F.round("z", 6).alias("z"))

    QUERIES[f"bin_{_mode}"] = lambda s, d, f=_bin2: f(s, d)
    ORACLE[f"bin_{_mode}"] = f"with {BINNED} select row, col, round({_agg}, 6) z from c group by row, col"


@query(f"with pts as ({PTS}), {EXTENT} select cast(floor((y1 - y) / 10.0 + 0.5) as int) row, cast(floor(x / 50.0 + 0.5) as int) col, sum(z * w) / sum(w) z, count(*) \"count\" from pts, e where x > 0 and x < x1 and y < y1 and y > y0 group by 1, 2")
def block_nodes_weighted(s, d):
    return S.block_nodes(points(s, d), cells_of(s, d), weighted=True)


@query(f"with {STACKED} select row, col, sum(sz) / sum(sw) z, sum(sx) / sum(sw) x, sum(sy) / sum(sw) y, sum(sw) / sum(n) weights, cast(sum(n) as bigint) \"count\", sqrt(sum(u*u)) src_uncertainty, round(sqrt(sum(u*u) + greatest(0, sum(szz)/sum(sw) - (sum(sz)/sum(sw)) * (sum(sz)/sum(sw)))), 6) uncertainty from s group by row, col")
def stack_mean(s, d):
    return S.stack(sums(s, d)).withColumn("uncertainty", F.round("uncertainty", 6))


for _mode, _order in (("min", "sz / sw"), ("max", "sz / sw desc"), ("supercede", "sw / n desc")):
    QUERIES[f"stack_{_mode}"] = lambda s, d, mode=_mode: S.stack(sums(s, d), mode).select("row", "col", "z", "weights", "count")
    ORACLE[f"stack_{_mode}"] = f'with {STACKED}, r as (select *, row_number() over (partition by row, col order by {_order}, source) k from s) select row, col, sz / sw z, sw / n weights, n "count" from r where k = 1'


@query(f"with {STACKED}, b as (select *, (sw/n >= 5)::int + (sw/n >= 6)::int band from s), t as (select *, max(band) over (partition by row, col) top from b) select row, col, sum(sz) / sum(sw) z, cast(sum(n) as bigint) \"count\" from t where band = top group by row, col".replace(", b as (select *, (sw", ", bb as (select *, (sw").replace("from b)", "from bb)"))
def stack_mixed(s, d):
    return S.stack(sums(s, d), "mixed", [5, 6]).select("row", "col", "z", "count")


@query(f"with {STACKED} select row, col, sum(sw) z from s group by row, col")
def stack_weights(s, d):
    return S.stack(sums(s, d), "weights").select("row", "col", "z")


@query(f"with {STACKED} select row, col, round(greatest(0, sum(szz)/sum(sw) - (sum(sz)/sum(sw)) * (sum(sz)/sum(sw))), 6) z from s group by row, col")
def stack_var(s, d):
    return S.stack(sums(s, d), "var").select("row", "col", F.round("z", 6).alias("z"))


@query(f"with {STACKED} select row, col, sum(sz) / sum(sw) z, cast(sum(n) as bigint) \"count\" from s group by row, col having sum(n) >= 100")
def stack_min_count(s, d):
    return S.stack(sums(s, d), min_count=100).select("row", "col", "z", "count")


@query(f"with {STACKED} select source, row, col, sz, sw, n \"count\" from s")
def stack_incremental(s, d):
    p, grid = points(s, d), cells_of(s, d)
    return S.merge_sums(S.source_sums(p.where("z < 20"), grid), S.source_sums(p.where("z >= 20"), grid)).select("source", "row", "col", "sz", "sw", "count")


@query(f"with {STACKED} select distinct row, col, split_part(source, '/', 1) source from s")
def stack_coverage(s, d):
    return S.coverage(sums(s, d), 1)


@query(f"with pts as ({PTS}) select count(*) numpts, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax from pts")
def point_statistics(s, d):
    return S.statistics(points(s, d))


@query(f"with pts as ({PTS}), m as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from pts) select least(9, floor((y-y0)*10/(y1-y0)))::int row, least(9, floor((x-x0)*10/(x1-x0)))::int col, sum(z*w)/count(*) z, count(*) \"count\" from pts, m group by 1, 2")
def mini_grid(s, d):
    return S.mini_grid(points(s, d))


KERNEL = lambda r, agg: f"with {MEAN} select a.row, a.col, {agg} z from g a join g b on b.row between a.row - {r} and a.row + {r} and b.col between a.col - {r} and a.col + {r} group by a.row, a.col, a.z"


@query(KERNEL(1, "median(b.z)"))
def grid_denoise(s, d):
    return G.denoise(surface(s, d))


@query(KERNEL(1, "min(b.z)"))
def grid_erosion(s, d):
    return G.morphology(surface(s, d), "erosion")


@query(KERNEL(1, "max(b.z)"))
def grid_dilation(s, d):
    return G.morphology(surface(s, d), "dilation")


@query(KERNEL(1, "round(sum(b.z * exp(-((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col)))) / sum(exp(-((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col)))), 6)"))
def grid_blur(s, d):
    return G.blur(surface(s, d)).withColumn("z", F.round("z", 6))


@query(KERNEL(2, "case when round(abs(a.z - avg(b.z)) / greatest(stddev_pop(b.z), 1e-6), 9) <= 1.5 then a.z end"))
def grid_zscore(s, d):
    return G.zscore(surface(s, d), 1.5)


@query(f"with {MEAN}, f as (select *, count(*) over (partition by z) k from g) select row, col, case when k <= 40 then z end z from f")
def grid_flats(s, d):
    return G.flats(surface(s, d), 40)


@query(f"with {MEAN} select row // 2 row, col // 2 col, avg(z) z from g group by 1, 2")
def grid_resample(s, d):
    return G.resample(surface(s, d), 2)


@query(f"with {MEAN} select row, col, least(26, greatest(25, z)) z from g")
def grid_clamp(s, d):
    return G.clamp(surface(s, d), 25, 26)


@query(f"with {MEAN} select row, col, z from g where not (row between 2 and 5 and col between 3 and 12)")
def grid_cut(s, d):
    return G.cut(surface(s, d), 2, 5, 3, 12, invert=True)


@query(f"with {MEAN} select least(4, floor((z - 20) * 5 / 10.0))::int bin, count(*) n, cast(sum(count(*)) over (order by least(4, floor((z - 20) * 5 / 10.0))::int) as bigint) cumulative from g where z between 20 and 30 group by 1")
def grid_histogram(s, d):
    return G.histogram(surface(s, d), 5, 20, 30)


@query(f"with {MEAN}, q as (select quantile_cont(z, 0.25) a, quantile_cont(z, 0.75) b from g) select a - (b - a) * 1.5 lower, b + (b - a) * 1.5 upper from q")
def grid_iqr_limits(s, d):
    return G.iqr_limits(surface(s, d), "z")


@query(f"with {MEAN}, h as (select row, col from g where z >= 26), far as (select g.* from g where z < 26 and not exists (select 1 from h where abs(h.row - g.row) <= 1 and abs(h.col - g.col) <= 1)) select row, col, z, z weights from g where z >= 26 union all select row, col, z, z from far")
def grid_weights(s, d):
    return G.weights(surface(s, d).withColumn("weights", F.col("z")), 26, 1)


@query(f"with {MEAN}, t as (select a.row, a.col, max(b.z) - min(b.z) roughness from g a join g b on abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 group by 1, 2) select * from t")
def grid_roughness(s, d):
    return G.terrain(surface(s, d)).select("row", "col", "roughness")


@query()
def grid_outliers(s, d):
    return G.outliers(surface(s, d))


@query(f"with {MEAN}, n as (select g.row, g.col, g.z, p.z pz, q.z nz, l.z lz, r.z rz from g left join g p on p.row = g.row - 1 and p.col = g.col left join g q on q.row = g.row + 1 and q.col = g.col left join g l on l.row = g.row and l.col = g.col - 1 left join g r on r.row = g.row and r.col = g.col + 1), k as (select row, col, coalesce((nz - pz) / 2, nz - z, z - pz, 0) gr, coalesce((rz - lz) / 2, rz - z, z - lz, 0) gc from n) select row, col, round(greatest(0, 255 * (cos(radians(45)) * cos(atan(sqrt(gr * gr + gc * gc))) + sin(radians(45)) * sin(atan(sqrt(gr * gr + gc * gc))) * cos(radians(135) - atan2(gr, -gc)))), 6) shade from k")
def grid_hillshade(s, d):
    return G.hillshade(surface(s, d)).withColumn("shade", F.round("shade", 6))


@query(f"with {MEAN}, a as (select row, col, case when z <= 26 then least(z, 25) end z from g) select count(*) cells, sum((a.z is null)::int)::bigint removed, count(case when a.z <> g.z then 1 end) changed, min(case when a.z <> g.z then a.z - g.z end) min_diff, max(case when a.z <> g.z then a.z - g.z end) max_diff, avg(case when a.z <> g.z then a.z - g.z end) mean_diff from g join a using (row, col)")
def grid_filter_statistics(s, d):
    g = surface(s, d)
    after = g.withColumn("z", F.when(F.col("z") <= 26, F.least(F.col("z"), F.lit(25.0))))
    return G.filter_statistics(g, after)


SPARSE = f"{MEAN}, k as (select row * 2 row, col * 2 col, z from g), t as (select row, col from (select unnest(range(0, cast((y1 - y0) / 5 as bigint)))::int row from e), (select unnest(range(0, cast(x1 / 25 as bigint)))::int col from e))"


def sparse(s, d):
    """All cells of the surface, as every second row and column of a finer grid."""
    return surface(s, d).withColumns({"row": F.col("row") * 2, "col": F.col("col") * 2})


def fine(s, d):
    """All cells of the finer grid."""
    grid = cells_of(s, d)
    return I.Whole(2 * grid.ny, 2 * grid.nx)


NEAR = lambda r: f"p as (select g.row, g.col, k.row nr, k.col nc, k.z nz, (g.row-k.row)*(g.row-k.row)+(g.col-k.col)*(g.col-k.col) d2 from t g join k on (g.row-k.row)*(g.row-k.row)+(g.col-k.col)*(g.col-k.col) <= {r * r})"


NEAREST = f"{SPARSE}, p as (select g.row, g.col, k.row nr, k.col nc, k.z nz, (g.row-k.row)*(g.row-k.row)+(g.col-k.col)*(g.col-k.col) d2 from t g, k), r as (select *, row_number() over (partition by row, col order by d2, nr, nc) q from p)"


@query(f"with {NEAREST} select row, col, round(coalesce(max(case when d2 = 0 then nz end), sum(case when d2 > 0 then nz / sqrt(d2) end) / sum(case when d2 > 0 then 1 / sqrt(d2) end)), 6) z from r where q <= 8 group by row, col")
def waffle_idw(s, d):
    return I.idw(fine(s, d), sparse(s, d), 1, 8).withColumn("z", F.round("z", 6))


@query(f"with {NEAREST} select row, col, nz z from r where q = 1")
def waffle_nearest(s, d):
    return I.nearest(fine(s, d), sparse(s, d))


@query(f"with {SPARSE}, {NEAR(3)} select row, col, avg(nz) z from p group by row, col having count(*) >= 3")
def waffle_average(s, d):
    return I.average(fine(s, d), sparse(s, d), 3, 3)


@query(f"with {SPARSE}, {NEAR(3)} select row, col, round(coalesce(max(case when d2 = 0 then nz end), sum(case when d2 > 0 then nz / d2 end) / sum(case when d2 > 0 then 1.0 / d2 end)), 6) z from p group by row, col")
def waffle_invdst(s, d):
    return I.inverse_distance(fine(s, d), sparse(s, d), 2, 0, 3).withColumn("z", F.round("z", 6))


@query(f"with {SPARSE}, {NEAR(5)}, r as (select *, (floor((atan2(nr - row, nc - col) + pi()) / (2 * pi()) * 4))::int % 4 s from p), f as (select *, row_number() over (partition by row, col, s order by d2, nr, nc) q from r) select row, col, round(sum(nz / (1 + 9 * d2 / 25.0)) / sum(1 / (1 + 9 * d2 / 25.0)), 6) z from f where q = 1 group by row, col")
def waffle_nearneighbor(s, d):
    return I.near_neighbor(fine(s, d), sparse(s, d), 5, 4).withColumn("z", F.round("z", 6))


@query(f"with {SPARSE}, {NEAR(4)} select g.row, g.col, round(sqrt(min(d2)), 9) distance from t g left join p using (row, col) group by 1, 2")
def waffle_proximity(s, d):
    return I.proximity(fine(s, d), sparse(s, d), 4).withColumn("distance", F.round("distance", 9))


@query(f"with {MEAN}, k as (select * from g), q as (select floor(sqrt((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col)) / 2)::int lag, (a.z-b.z)*(a.z-b.z) e from k a join k b on (a.row, a.col) <> (b.row, b.col)) select lag, count(*) n, sum(e) / (2 * count(*)) gamma from q where lag < 4 group by lag")
def waffle_variogram(s, d):
    return I.variogram(surface(s, d), 2, 4)


@query(f"with {MEAN} select row, col, (case when z > 25 then 1 else -1 end + 2 * case when n > 100 then 1 else -1 end > 0)::int land from g")
def waffle_coastline(s, d):
    g = S.stack(sums(s, d)).select("row", "col", F.floor("z").alias("z"), "count")
    a = g.select("row", "col", F.when(F.col("z") > 25, 1).otherwise(-1).alias("vote"))
    b = g.select("row", "col", F.when(F.col("count") > 100, 1).otherwise(-1).alias("vote"))
    return I.vote([(a, 1), (b, 2)])


@query(f"with {MEAN}, t as (select row, col, z, row + col dist from g) select row, col, round(sqrt((0.5 + 0.1 * dist) * (0.5 + 0.1 * dist) + z * z), 6) tvu from t")
def waffle_uncertainty(s, d):
    g = surface(s, d).select("row", "col", F.col("z").alias("src_uncertainty"), (F.col("row") + F.col("col")).alias("distance"))
    return I.total_uncertainty(g, 0.5, 0.1, 1.0).select("row", "col", F.round("tvu", 6).alias("tvu"))


EVENTS = "select *, cast(round(value * 100) as bigint) h from events"


def events(s, d):
    return table(s, d, "events").withColumn("h", F.round(F.col("value") * 100).cast("long"))


@query(f"with e as ({EVENTS}) select user_id, median(h) median, round(stddev_samp(h), 6) std, count(*) n, max(h) \"max\", min(h) \"min\" from e group by 1")
def segment_statistics(s, d):
    return sensor.segment_statistics(events(s, d), "user_id", "h").withColumn("std", F.round("std", 6))


@query(f"with e as ({EVENTS}), q as (select *, quantile_cont(h, 0.25) over (partition by user_id) a, quantile_cont(h, 0.75) over (partition by user_id) b from e) select event_id, case when h < a - 0.5 * (b - a) or h > b + 0.5 * (b - a) then 0 else 1 end cls from q")
def segment_noise(s, d):
    return sensor.segment_noise(events(s, d).withColumn("cls", F.lit(1)), "user_id", "h", "cls", 0.5).select("event_id", "cls")


@query(f"with e as ({EVENTS}), q as (select *, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) > 3600 then 1 else 0 end st from e) select event_id, cast(sum(st) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) island from q")
def event_islands(s, d):
    return sensor.islands(events(s, d), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3600, ["ts", "event_id"]).select("event_id", "island")


@query(f"with e as ({EVENTS}), q as (select *, count(h) over w n, min(h) over w a, max(h) over w b from e window w as (partition by user_id order by ts, event_id rows between 3 preceding and 2 following)) select event_id, n rolling_n, case when n >= 4 then a end rolling_min, case when n >= 4 then b end rolling_max from q")
def event_rolling(s, d):
    return sensor.rolling(events(s, d), "user_id", ["ts", "event_id"], "h", 3, 2, 4).select("event_id", "rolling_n", "rolling_min", "rolling_max")


@query("with p as (select n_nationkey k, case when n_regionkey > 1 then 40 + n_regionkey end new from nation where n_nationkey <> 7) select c_custkey, c_nationkey k, coalesce(p.new, c_custkey % 3) cls from customer left join p on p.k = c_nationkey")
def product_join(s, d):
    photons = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 3).alias("cls"))
    product = table(s, d, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey") + 40).alias("new"))
    return sensor.merge_product(photons, product, ["k"], "cls", "new")


@query("select s_suppkey, round(sqrt(pow((0.25 + 0.02 * abs(s_acctbal)) * 0.51, 2) + pow(0.005 * abs(s_nationkey), 2) + pow(least(14, abs(s_nationkey - 14)) * 0.51, 2)), 6) u, round(least(0.99, greatest(0.01, 1 - (2024 - (1980 + s_nationkey)) / 44.0)), 9) w from supplier")
def sonar_weights(s, d):
    t, k = table(s, d, "supplier"), F.col("s_nationkey")
    return t.select("s_suppkey", F.round(sensor.sonar_uncertainty(F.col("s_acctbal"), k, k), 6).alias("u"), F.round(sensor.age_weight(k + 1980), 9).alias("w"))


@query("select p_partkey, trim(regexp_replace(regexp_replace(strip_accents(lower(trim('-Über ' || p_type || ' é!'))), '[^a-z0-9_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '-') slug from part")
def slugs(s, d):
    return table(s, d, "part").select("p_partkey", scalar.slug(F.concat(F.lit("-Über "), "p_type", F.lit(" é!"))).alias("slug"))


@query("select p_partkey, round(2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(p_size % 50 - 10) / 2), 2) + cos(radians(10)) * cos(radians(p_size % 50)) * pow(sin(radians(p_partkey % 90) / 2), 2)))), 3) m from part")
def haversine(s, d):
    k = F.col("p_partkey") % 90
    return table(s, d, "part").select("p_partkey", F.round(scalar.haversine(F.lit(0), F.lit(10), k, F.col("p_size") % 50), 3).alias("m"))


@query("select cast(i as double) xmin, cast(i + 25 as double) xmax, cast(j as double) ymin, cast(j + 25 as double) ymax from range(0, 100, 25) a(i), range(0, 50, 25) b(j)")
def region_tiles(s, d):
    rows = [(t.xmin, t.xmax, t.ymin, t.ymax) for t in Region(0.0, 100.0, 0.0, 50.0).tiles(25.0)]
    return s.createDataFrame(rows, "xmin double, xmax double, ymin double, ymax double")


@query("select event_type, time_bucket(interval '1 day', ts) start, count(*) n, cast(sum(round(value * 100)) as bigint) total from events group by 1, 2")
def event_windows(s, d):
    e = table(s, d, "events").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return stream.windowed_counts(e, "ts", "event_type", "1 day", "1 hour").select("event_type", "start", "n", "total")


@query(f"with {STACKED} select source, row, col, sz, sw, n \"count\" from s")
def stream_stack(s, d):
    """The points as a stream, a file a batch, whose sums are kept, put together and read back."""
    grid, path = cells_of(s, d), f"{shared_dir(s)}/terragrid/stream-{uuid.uuid4().hex}"
    # three files, each with the rows of some lines
    lines = table(s, d, "lineitem")
    lines.withColumn("part", F.least(F.col("l_linenumber"), F.lit(3))).repartition(3, "part").drop("part").write.parquet(f"{path}/in")
    p = as_points(s.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    stream.keep_sums(p, grid, f"{path}/out", f"{path}/checkpoint", 2, availableNow=True).awaitTermination()
    return stream.read_sums(s, f"{path}/out").select("source", "row", "col", "sz", "sw", "count")


@query("select p_partkey, round(cos(radians(p_size)) * 111321.543::double, 3) lon, 111321.543::double lat, round(cos(radians(p_size::double / 60)) * 111321.543::double * (p_size::double / 60), 3) inc from part")
def degree_lengths(s, d):
    lon, lat = scalar.degree_lengths(F.col("p_size"))
    return table(s, d, "part").select("p_partkey", F.round(lon, 3).alias("lon"), lat.alias("lat"), F.round(scalar.increment_metres(F.col("p_size") / 60.0), 3).alias("inc"))


@query("with k as (select distinct c_nationkey g, c_custkey // 7 v from customer), i as (select *, v - row_number() over (partition by g order by v) r from k) select g, min(v) first, max(v) as last from i group by g, r")
def consecutive_runs(s, d):
    groups = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.collect_set(F.floor(F.col("c_custkey") / 7)).alias("v"))
    return groups.select("g", F.explode(scalar.consecutive_ranges(F.col("v"))).alias("r")).select("g", "r.first", "r.last")
