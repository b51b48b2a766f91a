"""Queries on regions, tracks, photons and more gridding, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tracks as K
from ..model import Region
from ..operators import grid as G
from ..operators import gridding as I
from ..operators import points as P
from ..operators import regions as R
from ..operators import stack as S
from ..operators import voids as V
from .areas import HOLES, IN, edges
from .queries import BINNED, EVENTS, MEAN, NEAREST, PTS, SPARSE, STACKED, XYZ, cells_of, events, fine, points, query, sparse, sums, surface, table, xyz

ORDERED = ["ts", "event_id"]


@query("select i, j, least(103, i * 20.0)::double xmin, least(103, (i + 1) * 20.0)::double xmax, least(47, 5 + j * 20.0)::double ymin, least(47, 5 + (j + 1) * 20.0)::double ymax from range(0, 6) a(i), range(0, 3) b(j)")
def region_chunks(s, d):
    return R.chunks(s, Region(0, 103, 5, 47), 2, 10)


@query("select cast(i as double) xmin, cast(i + 25 as double) xmax, cast(j as double) ymin, cast(j + 25 as double) ymax from range(0, 100, 25) a(i), range(0, 50, 25) b(j)")
def region_tile_table(s, d):
    return R.tiles(s, Region(0.0, 100.0, 0.0, 50.0), 25.0)


@query(f"with pts as ({PTS}), q as (select x / 100 x, y / 10 y from pts) select floor(x * 4) / 4 xmin, ceil(x * 4) / 4 xmax, floor(y * 4) / 4 ymin, ceil(y * 4) / 4 ymax, count(*) n from q group by all")
def region_quarter_tiles(s, d):
    box = [c.cast("double").alias(n) for c, n in zip(R.quarter_tile(F.col("x") / 100, F.col("y") / 10), ("xmin", "xmax", "ymin", "ymax"), strict=True)]
    return points(s, d).groupBy(*box).agg(F.count("*").alias("n"))


@query("with b as (select n_nationkey k, n_nationkey::double x0, n_nationkey + 4.0 x1, 10.0 y0, 12.0 y1 from nation), t as (select *, unnest(range(0, 4)) e from b), u as (select *, unnest(range(0, 4)) / 4.0 f from t) select k, case e when 0 then x0 when 1 then x0 + 4 * f when 2 then x1 else x1 - 4 * f end x, case e when 0 then y0 + 2 * f when 1 then y1 when 2 then y1 - 2 * f else y0 end y from u")
def region_dense_edges(s, d):
    boxes = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("double").alias("xmin"), (F.col("n_nationkey") + 4.0).alias("xmax"), F.lit(10.0).alias("ymin"), F.lit(12.0).alias("ymax"))
    return R.dense_edges(boxes, 4).select("k", "x", "y")


@query("select i wr, j wc, greatest(0, i * 7 - 2) row0, least(25, (i + 1) * 7 + 2) row1, greatest(0, j * 7 - 2) col0, least(17, (j + 1) * 7 + 2) col1 from range(0, 4) a(i), range(0, 3) b(j)")
def raster_windows(s, d):
    return R.windows(s, 25, 17, 7, 2)


@query(f"with {MEAN}, w as (select distinct row // 4 wr, col // 4 wc from g), q as (select *, w.wr * 4 r0, w.wc * 4 c0 from w) select q.wr, q.wc, count(*) n, count(*) filter (g.row // 4 = q.wr and g.col // 4 = q.wc) own from q join g on g.row between r0 - 1 and r0 + 4 and g.col between c0 - 1 and c0 + 4 group by 1, 2")
def raster_window_cells(s, d):
    got = R.in_windows(surface(s, d), 4, 1).groupBy("wr", "wc").agg(F.count("*").alias("n"), F.count_if("inner").alias("own"))
    return got.where("own > 0")


GAPPY = f"e as ({EVENTS}), o as (select event_id, user_id, ts, case when event_id % 3 > 0 then h end v from e)"


def gappy(s, d):
    return events(s, d).select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 > 0, F.col("h")).alias("v"))


@query(f"with {GAPPY} select event_id, coalesce(first(v ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following), last(v ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding)) v from o")
def track_fill(s, d):
    return K.fill_both(gappy(s, d), "user_id", ORDERED, "v").select("event_id", "v")


@query(f"with {GAPPY}, q as (select *, count(v) over w n, quantile_cont(v, 0.05) over w a, quantile_cont(v, 0.9) over w b, stddev_samp(v) over w c, avg(v) over w m from o window w as (partition by user_id order by ts, event_id rows between 4 preceding and 4 following)) select event_id, round(case when n >= 4 then a end, 6) rolling_low, round(case when n >= 4 then b end, 6) rolling_high, round(case when n >= 4 then c end, 6) rolling_std, round(case when n >= 4 then m end, 6) rolling_mean from q")
def track_rolling(s, d):
    got = K.rolling_spread(gappy(s, d), "user_id", ORDERED, "v", 4, 4, 4)
    return got.select("event_id", *(F.round(c, 6).alias(c) for c in ("rolling_low", "rolling_high", "rolling_std", "rolling_mean")))


@query(f"with {GAPPY} select event_id, round(coalesce(v, avg(v) over (partition by user_id order by ts, event_id rows between 7 preceding and 7 following)), 6) v from o")
def track_gaps(s, d):
    return K.fill_gaps(gappy(s, d), "user_id", ORDERED, "v").select("event_id", F.round("v", 6).alias("v"))


@query(f"with e as ({EVENTS}) select event_id, bool_or(h > 15000) over (partition by user_id) hit from e")
def track_any(s, d):
    return K.any_in_group(events(s, d), "user_id", F.col("h") > 15000, "hit").select("event_id", "hit")


PHOTONS = "select l_orderkey * 10 + l_linenumber id, l_partkey % 400 ph_segment_id, (l_quantity - 25) * (1 + l_partkey % 4) / 20.0 photon_height, l_linenumber % 5 confidence, cast(l_quantity as bigint) % 3 ph_h_classed, l_discount * 10 reflectance from lineitem"


def photons(s, d):
    return table(s, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber id", "l_partkey % 400 ph_segment_id", "(l_quantity - 25) * (1 + l_partkey % 4) / 20.0 photon_height", "l_linenumber % 5 confidence", "cast(l_quantity as bigint) % 3 ph_h_classed", "l_discount * 10 reflectance")


@query(f"with p as ({PHOTONS}), m as (select ph_segment_id, median(photon_height) m, stddev_samp(photon_height) s, median(reflectance) r from p where confidence >= 3 and ph_h_classed <> 0 group by 1), w as (select ph_segment_id from m where abs(m) <= 2.5 and (s <= 0.3 or (s <= 1.5 and r >= 0.4))) select ph_segment_id, case when w.ph_segment_id is not null and abs(photon_height) <= 2.5 and ph_h_classed < 40 then 41 else ph_h_classed end ph_h_classed, count(*) n from p left join w using (ph_segment_id) group by all")
def photon_nearshore(s, d):
    return K.nearshore(photons(s, d)).groupBy("ph_segment_id", "ph_h_classed").agg(F.count("*").alias("n"))


@query(f"with p as ({PHOTONS}) select case when ph_segment_id < 100 and abs(photon_height) < 2 then 44 else ph_h_classed end ph_h_classed, count(*) n from p group by 1")
def photon_ocean(s, d):
    return K.open_ocean(photons(s, d), F.col("ph_segment_id") < 100).groupBy("ph_h_classed").agg(F.count("*").alias("n"))


@query(f"with pts as ({PTS}), q as (select *, cast(z as bigint) % 3 c from pts) select case when {IN.format('(x - 0.5)', '(y - 0.5)')} and c <> 2 then 50 else c end cls, count(*) n from q group by 1")
def photon_polygons(s, d):
    p = V.inside_polygons(points(s, d).withColumn("cls", F.col("z").cast("long") % 3), edges(s), band=10.0)
    return K.classify_inside(p, "inside", "cls", 50, (2,)).groupBy("cls").agg(F.count("*").alias("n"))


CLOUD = "select p_partkey k, (p_partkey * 37 % 997)::double x, (p_partkey * 61 % 499)::double y from part"


@query(f"with recursive p as ({CLOUD}), n as (select a.k, b.k nk, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) d2 from p a join p b on (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 225), c as (select k from n group by k having count(*) >= 5), e as (select n.k, n.nk from n join c on c.k = n.k join c c2 on c2.k = n.nk), r as (select k, k l from c union select e.nk, r.l from r join e on e.k = r.k), m as (select k, min(l) l from r group by k), f as (select n.k, m.l, row_number() over (partition by n.k order by d2, n.nk) q from n join m on m.k = n.nk) select p.k, f.l as cluster from p left join f on f.k = p.k and q = 1")
def photon_clusters(s, d):
    t = table(s, d, "part").selectExpr("p_partkey k", "cast(p_partkey * 37 % 997 as double) x", "cast(p_partkey * 61 % 499 as double) y")
    return K.clusters(t, "k", "x", "y", 15.0, 5)


@query(f"with {BINNED} select {XYZ}, round(avg(z) over (partition by row, col), 9) mean from c")
def point_pixels(s, d):
    got = P.cell_mean(points(s, d), cells_of(s, d))
    return got.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"), F.round("cell_mean", 9).alias("mean"))


@query(f"with {BINNED} select row, col, count(*) n, min(id) low, max(id) high from c group by 1, 2")
def point_blocks(s, d):
    got = P.block_lists(points(s, d), cells_of(s, d))
    return got.select("row", "col", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("low"), F.element_at("ids", -1).alias("high"))


@query(f"with {STACKED}, r as (select *, row_number() over (partition by row, col order by sw / n desc, source) k from s) select row, col, source from r where k = 1")
def stack_coverage_superceded(s, d):
    return S.winning_source(sums(s, d))


@query(f"with {STACKED}, g as (select row, col from s group by 1, 2 having sum(n) >= 140) select distinct row, col, source from s semi join g using (row, col)")
def stack_coverage_valid(s, d):
    z = S.stack(sums(s, d)).where("count >= 140")
    return S.coverage_of_valid(S.coverage(sums(s, d)), z)


@query(f"with {STACKED} select distinct row, col, 1 z from s where source like 'A%'")
def stack_single_mask(s, d):
    return S.single_mask(S.coverage(sums(s, d)).where("source like 'A%'"))


@query(f"with {MEAN}, x as (select case when z = 25 then 0 else z end z from g) select quantile_cont(z, 0.3) p from x where z <> 0")
def grid_percentile(s, d):
    g = surface(s, d).withColumn("z", F.when(F.col("z") == 25, 0.0).otherwise(F.col("z")))
    return G.percentile_of_values(g, 30).withColumnRenamed("percentile", "p")


@query(f"with {MEAN}, q as (select quantile_cont(z, 0.25) a, quantile_cont(z, 0.75) b from g) select a - (b - a) * 1.5 lower, b + (b - a) * 1.5 upper from q")
def grid_iqr_offset(s, d):
    return G.iqr_limits(surface(s, d), "z", 75, 1.5, "offset")


@query(f"with {MEAN}, b as (select least(4, floor((z - 20) * 5 / 10.0))::int bin, sw from g where z between 20 and 30), h as (select bin, count(*) n, sum(sw) weight from b group by 1) select bin, n, weight, round(n / sum(n) over (), 9) pdf, round(sum(n) over (order by bin) / sum(n) over (), 9) cdf from h")
def grid_hypsometry(s, d):
    g = S.stack(sums(s, d)).select("row", "col", F.floor("z").cast("double").alias("z"), F.round(F.col("weights") * F.col("count")).alias("w"))
    got = G.hypsometry(g, 5, 20, 30, "w")
    return got.select("bin", "n", "weight", F.round("pdf", 9).alias("pdf"), F.round("cdf", 9).alias("cdf"))


HORN = "case when count(*) = 9 then 1 end ok, sum(case when j = 1 then (2 - abs(i)) * z when j = -1 then -(2 - abs(i)) * z end) / 8 / 50.0 dx, sum(case when i = -1 then (2 - abs(j)) * z when i = 1 then -(2 - abs(j)) * z end) / 8 / 10.0 dy"


@query(f"with {MEAN}, n as (select a.row, a.col, b.row - a.row i, b.col - a.col j, b.z from g a join g b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1), k as (select row, col, {HORN} from n group by 1, 2), f as (select *, atan(2 * sqrt(dx * dx + dy * dy)) s, atan2(-dy, -dx) a from k where ok = 1) select row, col, round(greatest(0, 255 * (sin(radians(45)) * cos(s) + cos(radians(45)) * sin(s) * cos(radians(135) - a))), 6) shade from f")
def grid_hillshade_horn(s, d):
    return G.hillshade_horn(surface(s, d), 50, 10, 315, 45, 2.0).withColumn("shade", F.round("shade", 6))


@query(f"with {NEAREST}, n as (select row, col, nz, d2 from r where q = 1) select t.row, t.col, round(avg(nz), 6) z from t join n on (t.row-n.row)*(t.row-n.row)+(t.col-n.col)*(t.col-n.col) <= n.d2 group by 1, 2")
def waffle_natural_neighbor(s, d):
    return I.natural_neighbor(fine(s, d), sparse(s, d)).withColumn("z", F.round("z", 6))


@query(f"with {NEAREST} select row, col, round(avg(nz), 6) z from r where q <= 5 group by 1, 2")
def waffle_knn(s, d):
    return I.knn_mean(fine(s, d), sparse(s, d), 5).withColumn("z", F.round("z", 6))


@query(f"with {SPARSE} select row, col, z from k")
def waffle_kriging_at_data(s, d):
    """Without a nugget, kriging gives data cells their value back; tests hold the others against plain solutions."""
    data = sparse(s, d)
    got = I.kriging(data.select("row", "col"), data, 8, "spherical", 0.0, 4.0, 12.0)
    return got.select("row", "col", F.round("z", 6).alias("z"))


@query()
def point_decimation(s, d):
    """At most 500 points, drawn by a hash that SQL doesn't have."""
    return xyz(P.decimate(points(s, d), 500))
