"""Operators without SQL against plain versions, and what regions, catalogs and module strings do."""

import math
import random

import numpy as np
import pytest
from terragrid.functions import tracks
from terragrid.model import Grid, Region
from terragrid.operators import grid, gridding, points, select, voids
from terragrid.sources import binary, text


def test_region_algebra():
    a, b = Region(0, 10, 0, 10, 0, 5), Region(5, 20, -5, 7)
    assert a.intersect(b) == Region(5, 10, 0, 7, 0, 5) and a.union(b) == Region(0, 20, -5, 10, 0, 5)
    assert a.intersects(b) and not a.intersects(Region(11, 12, 0, 1)) and Region(1, 2, 1, 2).within(a)
    assert a.buffer(1).xmax == 11 and a.buffer(1.4, 0.5).xmin == -1 and a.buffer_percent(10).ymin == -1
    assert a.cut(Region(2.3, 7.2, 1, 20), 1, 1) == Region(2, 8, 1, 20, 0, 5)
    assert a.cut(Region(50, 60, 50, 60)) == a
    assert a.centre == (5, 5) and a.increments(5, 2) == (2, 5)
    assert Region(-190, 180, -95, 3).on_earth() == Region(-180, 180, -90, 3) and Region(-190, 5, 0, 95).on_earth(True) == Region(-179.85, 5, 0, 89.85)
    r = Region.parse("-R-1/2/3/4/-/9/1/2")
    assert (r.zmin, r.zmax, r.wmin, r.wmax, r.umin) == (None, 9, 1, 2, None) and r.valid and not Region.parse("0/1/0/1/5/2").valid
    assert Region.parse(a.wkt()) == Region(0, 10, 0, 10) and Region.parse('{"type":"Polygon","coordinates":[[[0,0],[0,2],[1,2],[1,0],[0,0]]]}') == Region(0, 1, 0, 2)


@pytest.mark.parametrize("values", [[1.5], [2.0] * 40_000, list(range(60_000)), [1.0] * 30_000 + [2.0] * 30_000 + [1e9]])
def test_percentiles(spark, values):
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
    want = np.percentile(values, [0, 1, 25, 50, 99.9, 100])
    assert np.allclose(select.percentiles(df, "v", [0, 0.01, 0.25, 0.5, 0.999, 1]), want)
    assert select.percentiles(df.limit(0), "v", [0.5]) == [None]


def cells(spark, z):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row) if not math.isnan(v)], "row int, col int, z double")


def test_kernels_with_voids(spark):
    r = np.random.default_rng(4)
    z = np.where(r.random((9, 11)) < 0.25, np.nan, r.integers(0, 50, (9, 11)).astype(float))
    got = {name: {(x.row, x.col): x.z for x in f(cells(spark, z)).collect()} for name, f in {
        "median": lambda c: grid.denoise(c, 5), "blur": lambda c: grid.blur(c, 1), "opening": lambda c: grid.morphology(c, "opening", 3)}.items()}
    at = lambda a, i, j, k: [a[p][q] for p in range(max(0, i - k), min(9, i + k + 1)) for q in range(max(0, j - k), min(11, j + k + 1)) if not math.isnan(a[p][q])]
    low = np.array([[min(at(z, i, j, 1)) if not math.isnan(z[i, j]) else np.nan for j in range(11)] for i in range(9)])
    for i in range(9):
        for j in range(11):
            if math.isnan(z[i, j]):
                assert all((i, j) not in v for v in got.values())
                continue
            assert got["median"][i, j] == np.median(at(z, i, j, 2)) and got["opening"][i, j] == max(at(low, i, j, 1))
            w = [(math.exp(-((p - i) ** 2 + (q - j) ** 2)), z[p, q]) for p in range(max(0, i - 1), min(9, i + 2)) for q in range(max(0, j - 1), min(11, j + 2)) if not math.isnan(z[p, q])]
            assert abs(got["blur"][i, j] - sum(a * b for a, b in w) / sum(a for a, _ in w)) < 1e-9


def test_outliers_score(spark):
    z = np.add.outer(np.arange(15.0), np.arange(15.0))
    z[7, 7] = 500
    left = {(r.row, r.col) for r in grid.outliers(cells(spark, z)).where("z is null").collect()}
    assert (7, 7) in left and len(left) < 20
    flat = grid.flats(cells(spark, np.zeros((5, 5))), 10).where("z is not null").count()
    assert flat == 0


def test_connected_wide_rows(spark, monkeypatch):
    monkeypatch.setattr(voids, "SPAN", 3)
    r = np.random.default_rng(6)
    on = r.random((14, 17)) < 0.55
    for diagonal in (False, True):
        label = -np.ones(on.shape, int)
        for start in zip(*np.nonzero(on), strict=True):
            if label[start] >= 0:
                continue
            todo = [start]
            label[start] = start[0] * 100 + start[1]
            while todo:
                i, j = todo.pop()
                for di in (-1, 0, 1):
                    for dj in (-1, 0, 1):
                        p, q = i + di, j + dj
                        if (diagonal or not (di and dj)) and 0 <= p < 14 and 0 <= q < 17 and on[p, q] and label[p, q] < 0:
                            label[p, q] = label[start]
                            todo.append((p, q))
        df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(on), strict=True)], "row int, col int")
        got = {(x.row, x.col): ((x.label >> 32) * 100 + (x.label & 0xFFFFFFFF), x.size) for x in voids.connected(df, diagonal).collect()}
        assert got == {(int(i), int(j)): (label[i, j], int((label == label[i, j]).sum())) for i, j in zip(*np.nonzero(on), strict=True)}
    assert voids.connected(df.limit(0)).count() == 0


def test_unbounded_search(spark):
    """Data in one corner, cells far away: rings grow until all have their k."""
    data = spark.createDataFrame([(0, c, float(c)) for c in range(4)], "row int, col int, z double")
    targets = gridding.targets(spark, 40, 30)
    got = {(x.row, x.col): x.z for x in gridding.idw(targets, data, 2, 3).collect()}
    assert len(got) == 1200
    for (r, c), z in got.items():
        near = sorted((r * r + (c - k) ** 2, k) for k in range(4))[:3]
        want = near[0][1] if near[0][0] == 0 else sum(k / d for d, k in near) / sum(1 / d for d, _ in near)
        assert abs(z - want) < 1e-9
    assert gridding.nearest(targets, data.limit(0)).count() == 0


def test_kriging(spark):
    r = np.random.default_rng(3)
    at = sorted({(int(a), int(b)) for a, b in r.integers(0, 12, (25, 2))})
    data = spark.createDataFrame([(a, b, float(a * 2 + b)) for a, b in at], "row int, col int, z double")
    got = {(x.row, x.col): (x.z, x.variance) for x in gridding.kriging(gridding.targets(spark, 12, 12), data, 6, "exponential", 0.1, 3.0, 8.0).collect()}
    gamma = lambda h: 0.0 if h == 0 else 0.1 + 2.9 * (1 - math.exp(-3 * h / 8))
    for (i, j), (z, v) in got.items():
        near = sorted(((a - i) ** 2 + (b - j) ** 2, a, b) for a, b in at)[:6]
        m = np.ones((7, 7))
        m[6, 6] = 0
        m[:6, :6] = [[gamma(math.hypot(p[1] - q[1], p[2] - q[2])) for q in near] for p in near]
        b = np.array([gamma(math.sqrt(p[0])) for p in near] + [1.0])
        x = np.linalg.solve(m, b)
        assert abs(z - sum(w * (2 * p[1] + p[2]) for w, p in zip(x, near, strict=False))) < 1e-8 and abs(v - x @ b) < 1e-8


def test_coplanar(spark):
    pts = [(i, float(i % 6), float(i // 6), float(i % 6) + 2 * (i // 6)) for i in range(36)]
    pts[14] = (14, pts[14][1], pts[14][2], 60.0)
    left = {r.id for r in points.coplanar(spark.createDataFrame(pts, "id long, x double, y double, z double"), 1.5, 0.5, 3).collect()}
    assert 14 not in left and 35 in left


def test_decimation_is_repeatable(spark):
    df = spark.range(5000).select("id")
    a, b = ({r.id for r in points.decimate(x, 300).collect()} for x in (df, df.repartition(7)))
    assert a == b and len(a) == 300 and points.decimate(df.limit(20), 300).count() == 20


def test_las_and_guess(spark, tmp_path):
    xyz = np.array([[1.25, 2.5, -3.75], [100.0, 200.0, 300.0], [0, 0, 0]])
    data = binary.write_las(xyz, np.array([2, 1, 29]))
    (got, kinds), = binary.las_points(data)
    assert np.allclose(got, xyz) and kinds.tolist() == [2, 1, 29]
    with pytest.raises(ValueError):
        next(binary.las_points(b"no"))
    for name, lines, n in (("a", "# c\nx,y,z\n1,2,3\n\n4, 5 ,6\n7,8\n", 2), ("b", "1 2 3\n4\t5  6\n", 2), ("c", "1|2|nan\n1|2|4\n", 1)):
        (tmp_path / name).write_text(lines)
        assert text.read_xyz(spark, str(tmp_path / name), delimiter=None).count() == n


def test_geojson_geometries(spark, tmp_path):
    collection = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"elev":"7","w":2},"geometry":{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1],[0,0]],[[0.1,0.1,5],[0.2,0.1,5]]]}},\n{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[3,4]}}]}'
    (tmp_path / "c.json").write_text(collection)
    got = sorted((r.x, r.y, r.z, r.w) for r in text.read_geojson(spark, str(tmp_path / "c.json"), z_field="elev", weight_field="w", z=1.0).collect())
    assert len(got) == 7 and (3.0, 4.0, 1.0, None) in got and (0.1, 0.1, 5.0, 2.0) in got and (0.0, 1.0, 7.0, 2.0) in got


def test_catalog_without_entries(spark, tmp_path):
    (tmp_path / "x.datalist").write_text("# nothing\n\n")
    assert text.read_catalog(spark, str(tmp_path / "x.datalist")) is None
    table = text.catalog_table(spark, [text.parse_entry("'a b.xyz' 168 2 - t"), text.parse_entry("c.xyz")])
    assert [r.path for r in text.prune(table, Region(0, 1, 0, 1), weights=(2, 3)).collect()] == ["a b.xyz"]


def test_clusters_noise(spark):
    df = spark.createDataFrame([(i, i * 0.5, 0.0) for i in range(8)] + [(100, 50.0, 50.0)], "k long, x double, y double")
    got = {r.k: r.cluster for r in tracks.clusters(df, "k", "x", "y", 1.0, 3).collect()}
    assert got[0] in range(8) and len({got[i] for i in range(8)}) == 1 and got[100] is None


def test_grid_edges(spark):
    g = Grid.of(Region(0, 10, 0, 10), 5)
    rows = spark.createDataFrame([(0.0, 10.0), (9.9, 0.1), (5.0, 5.0)], "x double, y double").select(g.row().alias("r"), g.col().alias("c"))
    assert [tuple(r) for r in rows.collect()] == [(0, 0), (1, 1), (1, 1)]


def test_geojson_by_lines(spark, tmp_path):
    """Only a collection over several lines is read as a whole; the others by lines, each part in a task of its own."""
    point = lambda i: '{"type":"Feature","geometry":{"type":"Point","coordinates":[%d,0,1]},"properties":{}}' % i
    (tmp_path / "many.json").write_text("\n".join(map(point, range(20_000))) + "\n\n")
    (tmp_path / "one.json").write_text('{"type":"FeatureCollection","features":[' + point(30_000) + "," + point(30_001) + "]}")
    (tmp_path / "pretty.json").write_text('{"type":"FeatureCollection",\n"features":[\n' + point(40_000) + ",\n" + point(40_001) + "\n]}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        got = text.read_geojson(spark, str(tmp_path))
        assert sorted(r.x for r in got.collect()) == [*range(20_000), 30_000, 30_001, 40_000, 40_001]
        assert text.read_geojson(spark, str(tmp_path / "many.json")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_searches_by_tiles(spark, monkeypatch):
    """A whole grid in many tiles, data in two places and one of them twice, against plain loops."""
    monkeypatch.setattr(gridding, "TILE", 8)
    monkeypatch.setattr(gridding, "PACK", 4)
    r = np.random.default_rng(5)
    at = sorted({(int(a), int(b)) for a, b in r.integers(0, 9, (30, 2))} | {(40, 33), (41, 35)})
    pts = [(a, b, float(z)) for (a, b), z in zip(at, r.integers(0, 40, len(at)), strict=True)]
    data, whole = spark.createDataFrame(pts, "row int, col int, z double"), gridding.Whole(43, 37)
    every = [(i, j) for i in range(43) for j in range(37)]
    near = {c: sorted(((a - c[0]) ** 2 + (b - c[1]) ** 2, a, b, z) for a, b, z in pts) for c in every}
    idw = lambda p: p[0][3] if p[0][0] == 0 else sum(z / math.sqrt(d) for d, _, _, z in p) / sum(1 / math.sqrt(d) for d, *_ in p)
    to3 = {c: [p for p in near[c] if p[0] <= 9] for c in every}
    want = {
        "idw": {c: idw(near[c][:8]) for c in every},
        "nearest": {c: near[c][0][3] for c in every},
        "knn": {c: sum(p[3] for p in near[c][:5]) / 5 for c in every},
        "average": {c: sum(q[3] for q in p) / len(p) for c, p in to3.items() if len(p) >= 3},
        "invdst": {c: p[0][3] if p[0][0] == 0 else sum(q[3] / q[0] for q in p) / sum(1 / q[0] for q in p) for c, p in to3.items() if p},
        "proximity": {c: math.sqrt(p[0][0]) if p else None for c, p in to3.items()},
    }
    sector = lambda c, p: int((math.atan2(p[1] - c[0], p[2] - c[1]) + math.pi) / (2 * math.pi) * 4) % 4
    firsts = {c: list({sector(c, p): p for p in reversed(v)}.values()) for c, v in to3.items() if v}
    want["near"] = {c: sum(p[3] / (1 + p[0]) for p in v) / sum(1 / (1 + p[0]) for p in v) for c, v in firsts.items()}
    for cells in (whole, gridding.targets(spark, 43, 37)):
        got = {"idw": gridding.idw(cells, data, 1, 8), "nearest": gridding.nearest(cells, data), "knn": gridding.knn_mean(cells, data, 5), "average": gridding.average(cells, data, 3, 3), "invdst": gridding.inverse_distance(cells, data, 2, 0, 3), "proximity": gridding.proximity(cells, data, 3), "near": gridding.near_neighbor(cells, data, 3, 4)}
        for name, df in got.items():
            rows = [tuple(x) for x in df.collect()]
            assert len(rows) == len(want[name]), name
            assert all(v is want[name][i, j] is None or abs(v - want[name][i, j]) < 1e-9 for i, j, v in rows), name
    some = gridding.targets(spark, 43, 37).where("row % 5 = 2")
    assert {(x.row, x.col): x.z for x in gridding.nearest(some, data).collect()} == {c: z for c, z in want["nearest"].items() if c[0] % 5 == 2}
    pairs = [(int(math.hypot(a[0] - b[0], a[1] - b[1]) // 2), (a[2] - b[2]) ** 2) for a in [*pts, (40, 33, 7.0)] for b in [*pts, (40, 33, 7.0)] if a[:2] != b[:2]]
    want_v = {k: (sum(q == k for q, _ in pairs), sum(e for q, e in pairs if q == k)) for k in range(4)}
    twice = data.unionByName(spark.createDataFrame([(40, 33, 7.0)], "row int, col int, z double"))
    assert {x.lag: (x.n, round(2 * x.n * x.gamma, 6)) for x in gridding.variogram(twice, 2, 4).collect()} == {k: (n, round(e, 6)) for k, (n, e) in want_v.items() if n}


def lines(spark, path, rows):
    """A small lineitem table of (order, line, part, supplier, quantity)."""
    kinds = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(*map(int, r[:4]), float(r[4]), 0.05, 0.02, "A", "F") for r in rows], kinds).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_kriging_at_data_with_gaps(spark, tmp_path):
    """Cells without data, between those that have some, are not among the data's cells."""
    from terragrid.plans import queries

    d = lines(spark, tmp_path, [(i, 1, 60 * i % 700, 11 * i % 130, 1 + i % 30) for i in range(60)])
    got = {(r.row, r.col): r.z for r in queries.QUERIES["waffle_kriging_at_data"](spark, d).collect()}
    assert got == {(r.row, r.col): r.z for r in queries.sparse(spark, d).collect()}


def test_equal_ids_in_two_blocks(spark, tmp_path):
    """Each block has its lowest point, even where two of them have one id."""
    from terragrid.plans import queries

    d = lines(spark, tmp_path, [(1, 1, 10, 10, 5), (1, 1, 500, 10, 5), (2, 1, 20, 12, 9)])
    assert sorted(r.id for r in queries.QUERIES["points_block_thin_min"](spark, d).collect()) == [1105052, 1105052]


def test_void_shapes_by_runs(spark, monkeypatch):
    """Perimeters, borders and levels of voids against plain loops; no cell of a wide void is sent."""
    monkeypatch.setattr(voids, "SPAN", 3)
    r = np.random.default_rng(8)
    z = np.where(r.random((12, 19)) < 0.5, np.nan, r.integers(0, 50, (12, 19)).astype(float))
    z[:, 7:12] = np.nan
    data = cells(spark, z)
    label = {(x.row, x.col): x.label for x in voids.void_areas(data, 12, 19).collect()}
    assert set(label) == {(i, j) for i in range(12) for j in range(19) if math.isnan(z[i, j])}
    got = {x.label: x for x in voids.shapes(voids.settle(voids.void_runs(data, 12, 19), "areas"), data).collect()}
    flat = {(x.row, x.col): x.z for x in voids.flatten(data, 12, 19, 2).collect()}
    for k in set(label.values()):
        own = {c for c, v in label.items() if v == k}
        edge = {(i + a, j + b) for i, j in own for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= i + a < 12 and 0 <= j + b < 19} - set(label)
        assert (got[k].size, got[k].perimeter) == (len(own), sum((i + a, j + b) not in own for i, j in own for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))
        assert abs(got[k].border_std - np.std([z[c] for c in edge])) < 1e-9
        assert all(abs(flat[c] - np.percentile([z[e] for e in edge], 5)) < 1e-9 for c in own) if len(own) > 1 else not own & set(flat)


def test_box_join_once(spark):
    """Boxes over many cells meet once, without a pass that looks for repeats."""
    r = random.Random(3)
    rows = [(i, float(x), x + r.random() * 70, float(y), y + r.random() * 40) for i in range(60) for x, y in [(r.randrange(-50, 150), r.randrange(90))]]
    box = lambda k: spark.createDataFrame(rows, f"{k} int, xmin double, xmax double, ymin double, ymax double")
    df = text.box_join(box("a"), box("b"), 20.0, ("a", "b"))
    want = [(p[0], q[0]) for p in rows for q in rows if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]]
    assert sorted(map(tuple, df.collect())) == want
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_grid_in_many_files(spark, tmp_path):
    """Rows of a grid in files of very unequal sizes keep their places."""
    z = np.full((30, 40), np.nan)
    z[3, :], z[17, 5:9], z[29, 39] = 123456.75, 2, 7
    grid_ = Grid(10.0, 30.0, 1, 1, 40, 30)
    text.write_ascii_grid(cells(spark, z), grid_, str(tmp_path / "g"), file_cells=100)
    assert len(list((tmp_path / "g").glob("part-*"))) == 15
    got = {(30 - 0.5 - r.y, r.x - 10.5): r.z for r in text.read_ascii_grid(spark, str(tmp_path / "g")).collect()}
    assert got == {(i, j): z[i, j] for i in range(30) for j in range(40) if not math.isnan(z[i, j])}


def test_clusters_of_crowds(spark):
    """A crowd on few places, two near crowds, a row at the edge and noise against plain loops; pairs of a crowd aren't written."""
    r = random.Random(2)
    pts = [(float(r.randrange(3)), float(r.randrange(3))) for _ in range(300)] + [(20.0 + r.random() * 9, r.random() * 9) for _ in range(80)] + [(4.4, 2.0), (60.0, 60.0), (4.4, 2.0), (-30.0, 5.0)]
    keys = list(range(len(pts)))
    r.shuffle(keys)
    rows = [(k, *p) for k, p in zip(keys, pts, strict=True)]
    d2 = {(a[0], b[0]): (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 for a in rows for b in rows}
    near = {k: [n for n in keys if d2[k, n] <= 4.0] for k in keys}
    core = {k for k in keys if len(near[k]) >= 5}
    label = {}
    for k in sorted(core):
        todo = [k] if k not in label else []
        while todo:
            a = todo.pop()
            if a not in label:
                label[a] = k
                todo += [n for n in near[a] if n in core]
    want = {k: label[min((d2[k, n], n) for n in near[k] if n in core)[1]] if any(n in core for n in near[k]) else None for k in keys}
    got = {x.k: x.cluster for x in tracks.clusters(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y", 2.0, 5).collect()}
    assert got == want and None in want.values() and len(set(want.values())) > 2


def test_nearest_in_voids(spark, monkeypatch):
    """Large boxes are told candidate by candidate, the first of equals wins; cells far from all data, of a whole grid and some of one."""
    monkeypatch.setattr(gridding, "LARGE", 4)
    in_rows, in_cols = (np.random.default_rng(3).integers(0, 9, (11, n)) for n in (30, 20))
    at, best = gridding._first_nearest(in_rows, in_cols)
    every = in_rows[:, :, None] + in_cols[:, None, :]
    assert (at == every.argmin(axis=0)).all() and (best == every.min(axis=0)).all()
    pts = [(r, c, float(10 * r + c)) for r in (0, 2, 4) for c in (1, 3, 5, 7)] + [(299, 410, 5.0), (299, 414, 6.0)]
    data, (i, j) = spark.createDataFrame(pts, "row int, col int, z double"), np.mgrid[:301, :420]
    want = np.array([p[2] for p in pts])[np.stack([(i - p[0]) ** 2 + (j - p[1]) ** 2 for p in pts]).argmin(axis=0)]
    got = gridding.nearest(gridding.Whole(301, 420), data).toPandas()
    assert len(got) == want.size and (want[got["row"], got["col"]] == got["z"]).all()
    got = gridding.nearest(gridding.targets(spark, 301, 420).where("(row + col) % 3 = 0"), data).toPandas()
    assert len(got) == ((i + j) % 3 == 0).sum() and (want[got["row"], got["col"]] == got["z"]).all()


def test_natural_neighbor_in_voids(spark, monkeypatch):
    """Discs of cells far from all data go by runs and blocks, not cell by cell; values that a sum of doubles would lose, against plain loops."""
    monkeypatch.setattr(gridding, "TILE", 32)
    monkeypatch.setattr(gridding, "BLOCK", (16, 10))
    monkeypatch.setattr(gridding, "BLOCKS", 20)
    ny, nx = 70, 90
    zs = [3.0, 0.1, -7.25, 1e18, 12.0, 4e-9, 8.0, -2.5, 6.0]
    pts = [(r, c, zs.pop()) for r in (0, 2, 4) for c in (1, 3, 6)] + [(66, 85, 5.0)]
    i, j = (x.ravel() for x in np.mgrid[:ny, :nx])

    def want(keep, points):
        d = np.stack([(i - p[0]) ** 2 + (j - p[1]) ** 2 for p in points])
        near, d2 = np.array([p[2] for p in points])[d.argmin(axis=0)][keep], d.min(axis=0)[keep]
        gets = lambda a, b: near[(i[keep] - a) ** 2 + (j[keep] - b) ** 2 <= d2].tolist()
        return {(a, b): math.fsum(x) / len(x) if np.isfinite(x).all() else sum(x) for a, b in zip(i[keep].tolist(), j[keep].tolist(), strict=True) for x in [gets(a, b)]}

    every, some = np.ones(len(i), bool), (i + j) % 3 == 0
    odd = [*pts[:4], (4, 6, math.inf), (5, 20, math.nan), (60, 5, -math.inf)]
    cells = gridding.targets(spark, ny, nx)
    for at, keep, points in ((gridding.Whole(ny, nx), every, pts), (cells, every, odd), (cells.where("(row + col) % 3 = 0"), some, pts), (cells.where("row > 99"), every[:0], pts)):
        df = gridding.natural_neighbor(at, spark.createDataFrame(points, "row int, col int, z double"))
        assert "explode" not in df._jdf.queryExecution().optimizedPlan().toString()
        got = {(x.row, x.col): x.z for x in df.collect()}
        if not len(keep):
            assert not got
            continue
        expected = want(keep, points)
        assert got.keys() == expected.keys()
        for c, z in expected.items():
            assert got[c] == z or math.isnan(z) and math.isnan(got[c]) or abs(got[c] - z) <= 1e-12 * abs(z), c
