"""Queries on connected areas, limits and polygons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gridding as I
from ..operators import stack as S
from ..operators import post as W
from ..operators import voids as V
from .queries import BINNED, MEAN, NEAREST, SPARSE, cells_of, fine, points, query, sparse, sums, surface, xyz, XYZ

#: cells of the mean surface up to a height as data, the others of the grid as voids
HOLES = f"{MEAN}, d as (select row, col, z from g where z <= 25), every as (select row, col from (select unnest(range(0, cast((y1 - y0) / 10 as bigint)))::int row from e), (select unnest(range(0, cast(x1 / 50 as bigint)))::int col from e)), v as (select row, col from every anti join d using (row, col))"
REACH = f"{HOLES}, r as (select row, col, row l, col k from v union select n.row, n.col, r.l, r.k from r join v n on abs(n.row - r.row) + abs(n.col - r.col) = 1), a as (select row, col, min(l * 4294967296 + k) label from r group by row, col), w as (select *, count(*) over (partition by label) size from a)"


def data(s, d):
    return surface(s, d).where("z <= 25")


def size(s, d):
    g = cells_of(s, d)
    return g.ny, g.nx


@query(f"with recursive {REACH} select row, col, label, size from w")
def void_areas(s, d):
    return V.void_areas(data(s, d), *size(s, d))


BORDER = "n as (select distinct w.label, d.row, d.col, d.z from w join d on abs(d.row - w.row) <= 1 and abs(d.col - w.col) <= 1)"


@query(f"with recursive {REACH}, {BORDER}, f as (select label, quantile_cont(z, 0.05) z from n group by label) select row, col, z from d union all select w.row, w.col, f.z from w join f using (label) where size >= 3")
def void_flatten(s, d):
    return V.flatten(data(s, d), *size(s, d), 3)


@query(f"with recursive {REACH} select g.row, g.col, g.z from g anti join (select row, col from w where size >= 4) x using (row, col)")
def void_size_limit(s, d):
    return V.size_limit(surface(s, d), data(s, d), *size(s, d), 4)


@query(f"with recursive {REACH}, q as (select quantile_cont(size, 0.7) c from (select distinct label, size from w)) select g.row, g.col, g.z from g anti join (select row, col from w, q where size >= c) x using (row, col)")
def void_percentile_limit(s, d):
    return V.percentile_limit(surface(s, d), data(s, d), *size(s, d), 70)


@query(f"with recursive {REACH}, {BORDER}, p as (select w.label, count(*) perimeter from w, (values (1,0),(-1,0),(0,1),(0,-1)) o(i,j) where not exists (select 1 from w x where x.label = w.label and x.row = w.row + i and x.col = w.col + j) group by 1), b as (select label, stddev_pop(z) b from n group by 1) select label, size, perimeter, round(4 * pi() * size / (perimeter * perimeter), 9) circularity, round(b, 9) border_std from (select distinct label, size from w) join p using (label) left join b using (label)")
def void_shapes(s, d):
    from ..tables import settle

    g = data(s, d)
    areas = settle(V.void_runs(g, *size(s, d)), "areas")
    return V.shapes(areas, g).withColumns({"circularity": F.round("circularity", 9), "border_std": F.round("border_std", 9)})


@query(f"with recursive {REACH}, p as (select w.label, count(*) perimeter from w, (values (1,0),(-1,0),(0,1),(0,-1)) o(i,j) where not exists (select 1 from w x where x.label = w.label and x.row = w.row + i and x.col = w.col + j) group by 1) select label, size, perimeter from (select distinct label, size from w) join p using (label) where size >= 5 and 4 * pi() * size / (perimeter * perimeter) <= 0.45")
def void_rivers(s, d):
    return V.rivers(data(s, d), *size(s, d), 5, 0.45).select("label", "size", "perimeter")


@query(f"with recursive {MEAN}, v as (select row, col from g where z >= 25), r as (select row, col, row l, col k from v union select n.row, n.col, r.l, r.k from r join v n on abs(n.row - r.row) + abs(n.col - r.col) = 1), a as (select row, col, min(l * 4294967296 + k) label from r group by row, col), w as (select *, count(*) over (partition by label) size from a) select g.row, g.col, case when w.size < 6 then null else g.z end z, g.z weights from g left join w using (row, col)")
def grid_weight_zones(s, d):
    return V.weight_zones(surface(s, d).withColumn("weights", F.col("z")), 25, 6).select("row", "col", "z", "weights")


@query(f"with recursive {MEAN}, r as (select row, col, row l, col k, z from g union select n.row, n.col, r.l, r.k, r.z from r join g n on n.z = r.z and abs(n.row - r.row) + abs(n.col - r.col) = 1), a as (select row, col, min(l * 4294967296 + k) label from r group by row, col) select row, col, label, count(*) over (partition by label) size from a")
def grid_polygonise(s, d):
    return V.connected(surface(s, d), value="z")


@query(f"with {MEAN} select row, col, case when n > 140 then z end z from g")
def limit_count(s, d):
    return V.count_limit(S.stack(sums(s, d)).select("row", "col", F.floor("z").cast("double").alias("z"), "count"), 140).select("row", "col", "z")


@query(f"with {MEAN}, d as (select * from g where z > 27), m as (select min(row) a, min(col) b from d) select row - a row, col - b col, z from d, m")
def grid_crop(s, d):
    return V.crop(surface(s, d).where("z > 27"))


@query(f"with {MEAN}, o as (select unnest(range(0, 2))::int o), t as (select g.row * 2 + a.o row, g.col * 2 + b.o col from g, o a, o b), p as (select t.row, t.col, g.z, (1 - abs((t.row + 0.5) / 2 - 0.5 - g.row)) * (1 - abs((t.col + 0.5) / 2 - 0.5 - g.col)) w from t join g on abs((t.row + 0.5) / 2 - 0.5 - g.row) < 1 and abs((t.col + 0.5) / 2 - 0.5 - g.col) < 1) select row, col, round(sum(w * z) / sum(w), 9) z from p group by 1, 2")
def grid_bilinear(s, d):
    return V.bilinear(surface(s, d), 2).withColumn("z", F.round("z", 9))


@query(f"with {MEAN}, h as (select row, col, z from g where z >= 27), l as (select row, col, z from g where z < 27), n as (select l.row, l.col, l.z, h.z hz, sqrt((l.row-h.row)*(l.row-h.row)+(l.col-h.col)*(l.col-h.col)) d, row_number() over (partition by l.row, l.col order by (l.row-h.row)*(l.row-h.row)+(l.col-h.col)*(l.col-h.col), h.row, h.col) q from l join h on abs(l.row - h.row) <= 1 and abs(l.col - h.col) <= 1) select row, col, z from h union all select l.row, l.col, round(coalesce(n.z * least(1, d / 2) + hz * (1 - least(1, d / 2)), l.z), 9) from l left join n on n.row = l.row and n.col = l.col and q = 1")
def grid_blend(s, d):
    g = surface(s, d)
    return V.blend(g.where("z >= 27"), g.where("z < 27"), 1).withColumn("z", F.round("z", 9))


#: a square with a square hole
RINGS = [[(100, 10), (1100, 10), (1100, 85), (100, 85)], [(300, 30), (700, 30), (700, 60), (300, 60)]]
IN = "({0} between 100 and 1100 and {1} between 10 and 85 and not ({0} between 300 and 700 and {1} between 30 and 60))"


def edges(s):
    return s.createDataFrame([(a + 0.5, b + 0.5, c + 0.5, e + 0.5) for a, b, c, e in V.edges_of(RINGS)], "x1 double, y1 double, x2 double, y2 double")


@query(f"with {BINNED} select {XYZ} from c where {IN.format('(x - 0.5)', '(y - 0.5)')}")
def points_polygon_holes(s, d):
    return xyz(V.inside_polygons(points(s, d), edges(s), band=10.0).where("inside"))


@query(f"with {HOLES} select row, col, {IN.format('((col + 0.5) * 50 - 0.5)', '(y1 - (row + 0.5) * 10 - 0.5)')}::int z from every, e")
def grid_rasterise(s, d):
    return V.rasterise(s, edges(s), cells_of(s, d), 10.0)


@query(f"with {MEAN} select row, col, z from g, e where not {IN.format('((col + 0.5) * 50 - 0.5)', '(y1 - (row + 0.5) * 10 - 0.5)')}")
def grid_clip_inverted(s, d):
    return V.clip(surface(s, d), edges(s), cells_of(s, d), True, 10.0)


FILL = "p as (select v.row, v.col, d.row nr, d.col nc, d.z nz, (v.row-d.row)*(v.row-d.row)+(v.col-d.col)*(v.col-d.col) d2 from v join d on (v.row-d.row)*(v.row-d.row)+(v.col-d.col)*(v.col-d.col) <= 4), q as (select *, row_number() over (partition by row, col order by d2, nr, nc) k from p)"


@query(f"with {HOLES}, {FILL} select row, col, z from d union all select row, col, round(sum(nz / sqrt(d2)) / sum(1 / sqrt(d2)), 6) from q where k <= 8 group by row, col")
def void_fill(s, d):
    return V.fill(data(s, d), *size(s, d), "idw", 2).withColumn("z", F.round("z", 6))


@query(f"with recursive {REACH}, near as (select g.row, g.col from g join d on (g.row - d.row) * (g.row - d.row) + (g.col - d.col) * (g.col - d.col) < 4 group by 1, 2), k as (select g.row, g.col, g.z from g semi join near using (row, col) anti join (select row, col from w where size >= 5) x using (row, col)), m as (select a.row, a.col, median(b.z) z from k a join k b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2) select row, col, least(26, greatest(24, z)) z from m")
def dem_process(s, d):
    """Limits, a filter by its module string and bounds, in their order."""
    return W.process(surface(s, d), data(s, d), *size(s, d), proximity_limit=2, size_limit=5, filters=["denoise:kernel_size=3"], lower=24, upper=26)


@query(f"with {HOLES}, x as (select * from d where (z <= 24)), b as (select row // 2 r, col // 2 c, avg(z) z from x group by 1, 2), q as (select row // 4 r, col // 4 c, avg(z) z from x group by 1, 2) select e2.row, e2.col, round(coalesce(x.z, b.z, q.z), 9) z, case when x.z is not null then 1 when b.z is not null then 2 else 4 end factor from every e2 left join x using (row, col) left join b on b.r = e2.row // 2 and b.c = e2.col // 2 left join q on q.r = e2.row // 4 and q.c = e2.col // 4 where coalesce(x.z, b.z, q.z) is not null")
def dem_coarse_to_fine(s, d):
    return W.coarse_to_fine(surface(s, d).where("z <= 24"), *size(s, d), (2, 4)).withColumn("z", F.round("z", 9))


@query(f"with {HOLES} select d.row, d.col, d.z from d semi join (select a.row, a.col from every a join d b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1) x using (row, col)")
def dem_nothing_to_do(s, d):
    """Without limits the surface stays as it is."""
    return W.process(data(s, d), data(s, d), *size(s, d))
