"""Further modes and parameters of operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, sensor
from ..model import Region
from ..operators import grid as G
from ..operators import points as P
from ..operators import stack as S
from .queries import BINNED, EXTENT, MEAN, PTS, STACKED, XYZ, cells_of, points, query, sums, surface, table, xyz

OTHER = f"{MEAN}, o as (select row, col, z + (row % 3) - 1 z from g where (row + col) % 7 <> 0)"


def other(s, d):
    """The surface a little off, with gaps."""
    return surface(s, d).where("(row + col) % 7 <> 0").withColumn("z", F.col("z") + F.col("row") % 3 - 1)


@query(f"with {OTHER} select g.row, g.col, g.z - o.z z from g left join o using (row, col)")
def grid_diff(s, d):
    return G.diff(surface(s, d), other(s, d))


@query(f"with {OTHER} select g.row, g.col, case when coalesce(abs((g.z - o.z) / nullif(o.z, 0)) <= 0.03, true) then g.z end z from g left join o using (row, col)")
def grid_diff_relative(s, d):
    return G.diff(surface(s, d), other(s, d), 0.03, "relative")


@query(f"with {OTHER} select g.row, g.col, coalesce(o.z, g.z) z from g left join o using (row, col)")
def grid_mosaic(s, d):
    return G.mosaic([other(s, d), surface(s, d)])


@query(f"with {MEAN} select row, col, z, 1 side from g where z > 25 union all select row, col, z, -1 from g where z < 25")
def grid_split(s, d):
    above, below = G.split_by_value(surface(s, d), 25)
    return above.withColumn("side", F.lit(1)).unionByName(below.withColumn("side", F.lit(-1)))


def _twice(first: str, then: str) -> str:
    return f"with {MEAN}, f as (select a.row, a.col, {first}(b.z) z from g a join g b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2) select a.row, a.col, {then}(b.z) z from f a join f b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2"


@query(_twice("min", "max"))
def grid_opening(s, d):
    return G.FILTERS.apply(surface(s, d), "morphology:operation=opening")


@query(_twice("max", "min"))
def grid_closing(s, d):
    return G.morphology(surface(s, d), "closing")


@query(_twice("max", "min"))
def grid_hydro(s, d):
    return G.FILTERS.apply(surface(s, d), "hydro")


@query(f"with {MEAN} select a.row, a.col, max(b.z) - min(b.z) roughness, round(a.z - (sum(b.z) - a.z) / (count(*) - 1), 9) tpi, round(sqrt(sum((b.z - a.z) * (b.z - a.z))), 9) tri from g a join g b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by a.row, a.col, a.z having count(*) > 1")
def grid_terrain(s, d):
    return G.terrain(surface(s, d)).select("row", "col", "roughness", F.round("tpi", 9).alias("tpi"), F.round("tri", 9).alias("tri"))


SIDES = f"{MEAN}, n as (select g.row, g.col, g.z, p.z pz, q.z nz, l.z lz, r.z rz from g left join g p on p.row = g.row - 1 and p.col = g.col left join g q on q.row = g.row + 1 and q.col = g.col left join g l on l.row = g.row and l.col = g.col - 1 left join g r on r.row = g.row and r.col = g.col + 1), k as (select row, col, z, coalesce((nz - pz) / 2, nz - z, z - pz, 0) gr, coalesce((rz - lz) / 2, rz - z, z - lz, 0) gc from n)"


@query(f"with {SIDES} select row, col, case when sqrt(gr * gr + gc * gc) <= 0.8 then z end z from k")
def grid_slope(s, d):
    return G.FILTERS.apply(surface(s, d), "slope:max_val=0.8")


for _how, _agg in {"min": "min(z)", "max": "max(z)", "med": "median(z)", "sum": "sum(z)", "Q1": "quantile_cont(z, 0.25)", "Q3": "quantile_cont(z, 0.75)"}.items():

    def _resample(s, d, how=_how):
        return G.resample(surface(s, d), 3, how)

    _resample.__name__ = f"grid_resample_{_how.lower()}"
    query(f"with {MEAN} select row // 3 row, col // 3 col, {_agg} z from g group by 1, 2")(_resample)


@query(f"with {MEAN}, d as (select row, col from g where z > 26), u as (select distinct d.row + i row, d.col + j col from d, (select unnest(range(-1, 2)) i), (select unnest(range(-1, 2)) j)), f as (select u.row + i row, u.col + j col from u, (select unnest(range(-1, 2)) i), (select unnest(range(-1, 2)) j)), k as (select row, col from f group by 1, 2 having count(*) = 9) select g.row, g.col, g.z from g semi join k using (row, col)")
def limit_expand(s, d):
    g = surface(s, d)
    return G.expand_limit(g, g.where("z > 26"), 1)


@query(f"with {STACKED} select row, col, round(sqrt(greatest(0, sum(szz)/sum(sw) - (sum(sz)/sum(sw)) * (sum(sz)/sum(sw)))), 6) z from s group by row, col")
def stack_std(s, d):
    return S.stack(sums(s, d), "std").select("row", "col", F.round("z", 6).alias("z"))


@query(f"with {STACKED} select row, col, sum(sz) z from s group by row, col")
def stack_sums(s, d):
    return S.stack(sums(s, d), "sums").select("row", "col", "z")


@query(f"with {STACKED} select round(sum(sx) / sum(sw), 6) x, round(sum(sy) / sum(sw), 6) y, round(sum(sz) / sum(sw), 6) z, round(sum(sw) / sum(n), 6) w from s group by row, col")
def stack_to_points(s, d):
    got = S.stack_points(S.stack(sums(s, d)), cells_of(s, d), node=True)
    return got.select(*(F.round(c, 6).alias(c) for c in "xyzw"))


@query(f"with {BINNED} select row, col, sum(z) / count(*) z, sum(x) / count(*) x, sum(y) / count(*) y, sum(w) weight, round(sqrt(max(u) * max(u) + var_pop(z)), 6) uncertainty, count(*) \"count\" from c group by row, col")
def bin_mean_all_columns(s, d):
    return S.bin_points(points(s, d), cells_of(s, d), "mean").withColumns({"uncertainty": F.round("uncertainty", 6), "weight": F.round("weight", 6)})


@query(f"with pts as ({PTS}), {EXTENT} select cast(floor((y1 - y) / 10.0 + 0.5) as int) row, cast(floor(x / 50.0 + 0.5) as int) col, sum(z) / count(*) z, count(*) \"count\" from pts, e where x > 0 and x < x1 and y < y1 and y > y0 group by 1, 2")
def block_nodes(s, d):
    return S.block_nodes(points(s, d), cells_of(s, d))


def _blocks(order: str) -> str:
    return f"with pts as ({PTS}), m as (select min(x) x0, min(y) y0 from pts), b as (select pts.*, floor((x - x0) / 50) bx, floor((y - y0) / 50) b_y from pts, m), k as (select *, avg(z) over (partition by bx, b_y) mean, median(z) over (partition by bx, b_y) mid from b), r as (select *, row_number() over (partition by bx, b_y order by {order}, id) q from k) select cast(id as bigint) id from r where q = 1"


@query(_blocks("z"))
def points_block_thin_min(s, d):
    return P.FILTERS.apply(points(s, d), "block_thin:res=50:mode=min").select("id")


@query(_blocks("abs(z - mid)"))
def points_block_thin_median(s, d):
    return P.block_thin(points(s, d), 50, "median").select("id")


@query(_blocks("abs(z - mean)"))
def points_block_thin_mean(s, d):
    return P.block_thin(points(s, d), 50, "mean").select("id")


@query(f"with pts as ({PTS}), r as (select *, row_number() over (partition by floor(x/50), floor(y/50) order by pow(x - (floor(x/50) + 0.5) * 50, 2) + pow(y - (floor(y/50) + 0.5) * 50, 2), id) k from pts) select cast(id as bigint) id from r where k = 1")
def points_density_center(s, d):
    return P.density(points(s, d), 50, "center").select("id")


@query(f"with pts as ({PTS}), r as (select *, row_number() over (partition by floor(x/50), floor(y/50) order by z, id) k from pts) select cast(id as bigint) id from r where k > 1")
def points_block_min_inverted(s, d):
    return P.block_minmax(points(s, d), 50, "min", invert=True).select("id")


@query(f"with pts as ({PTS}) select cast((x + 5) * 2 as bigint) x, cast((y + 5) * 2 as bigint) y, cast(z * 3 as bigint) z, cast(w * 2 as bigint) w, round(sqrt(u * u + 9), 6) u from pts where z is not null")
def points_effective(s, d):
    got = P.finite(P.scaled(P.effective(points(s, d), 2.0, 3.0), 5.0, 2.0, 3.0))
    return got.select(*(F.col(c).cast("long").alias(c) for c in "xyzw"), F.round("u", 6).alias("u"))


@query(f"with pts as ({PTS}) select {XYZ} from pts where x between 10 and 500 and y between 5 and 50 and not (z between 10 and 20)")
def points_chain(s, d):
    return xyz(P.chain(points(s, d), ["region:region=10/500/5/50", "rangez:min_z=10:max_z=20:invert=true"]))


BEAMS = "select s_suppkey id, s_nationkey % 2 beamflag, s_nationkey speed, s_acctbal / 500 roll, s_suppkey % 60 grazing, s_suppkey % 70 slope from supplier"


@query(f"with b as ({BEAMS}) select id from b where beamflag = 0 and speed > 2 and abs(roll) < 10 and abs(grazing) > 20 and abs(slope) < 50")
def sonar_quality(s, d):
    t = table(s, d, "supplier").selectExpr("s_suppkey id", "s_nationkey % 2 beamflag", "s_nationkey speed", "s_acctbal / 500 roll", "s_suppkey % 60 grazing", "s_suppkey % 70 slope")
    return sensor.sonar_quality(t).select("id")


@query("select event_id, round(least(4, sum((value > 50)::int) over (partition by user_id) / 29.0), 9) reflectance from events")
def photon_reflectance(s, d):
    return sensor.reflectance(table(s, d, "events"), "user_id", F.col("value") > 50).select("event_id", F.round("reflectance", 9).alias("reflectance"))


@query("select c_custkey, round(20.0 * c_custkey / nullif(max(c_custkey) over (partition by c_nationkey), 0), 9) depth from customer")
def lake_depth(s, d):
    t = table(s, d, "customer").withColumn("deep", F.lit(20.0))
    return sensor.lake_depth(t, "c_nationkey", "c_custkey", "deep").select("c_custkey", F.round("depth", 9).alias("depth"))


@query("select p_partkey, round(radians(p_partkey % 180) * 6378137, 3) x, round(ln(tan(pi() / 4 + radians(p_size) / 2)) * 6378137, 3) y, round(p_partkey % 180, 6)::double lon, round(p_size, 6)::double lat from part")
def web_mercator(s, d):
    x, y = scalar.web_mercator(F.col("p_partkey") % 180, F.col("p_size"))
    lon, lat = scalar.from_web_mercator(x, y)
    return table(s, d, "part").select("p_partkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("select n_nationkey, 'POLYGON ((' || n_nationkey || ' 0,' || n_nationkey || ' 2,' || (n_nationkey + 1) || ' 2,' || (n_nationkey + 1) || ' 0,' || n_nationkey || ' 0))' wkt from nation")
def box_wkt(s, d):
    k = F.col("n_nationkey")
    return table(s, d, "nation").select("n_nationkey", scalar.box_wkt(k, k + 1, F.lit(0), F.lit(2)).alias("wkt"))


@query(f"with pts as ({PTS}) select {XYZ} from pts where x between 100 and 900 and y between 20 and 80 and z >= 5")
def region_of_text(s, d):
    """A region read from its own formats."""
    r = Region.parse(Region.parse(Region(100, 900, 20, 80).wkt()).format("gmt") + "/5/-")
    return xyz(P.in_region(points(s, d), r))
