"""Readers and writers of point text, ASCII grids, GeoJSON and catalogs."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITER = r"[\s,;|/:]+"


#: tried in this order; white space is the last
KNOWN_DELIMITERS = (",", "/", ":", ";", "|")


def guess_delimiter(spark: SparkSession, path: str, lines: int = 100) -> str:
    """The first known delimiter that parts some line among the first ones into three numbers."""
    some = [r[0].strip() for r in spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").head(lines)]

    def numbers(parts):
        try:
            return len([float(p) for p in parts[:3]]) == 3
        except ValueError:
            return False

    for d in KNOWN_DELIMITERS:
        if any(numbers(line.split(d)) for line in some):
            return r"\s*" + re.escape(d) + r"\s*"
    return r"\s+"


def points_of_lines(lines: DataFrame, positions: tuple = (0, 1, 2, None, None), delimiter: str = DELIMITER, scale: tuple = (1.0, 1.0, 1.0), offset: tuple = (0.0, 0.0), wrap: bool = False, keep: tuple = ()) -> DataFrame:
    """x, y, z, w, u of lines (value): x and y as (v + offset) * scale, z as z * scale; wrap: x to -180 .. 180.

    Comments and lines without three numbers, headers too, are dropped.
    """
    parts = F.split(F.trim("value"), delimiter)
    get = lambda i: F.lit(None).cast("double") if i is None else F.get(parts, F.lit(i)).try_cast("double")
    points = lines.where("trim(value) <> '' and not startswith(trim(value), '#')").select(*(get(i).alias(c) for c, i in zip("xyzwu", positions, strict=True)), *keep)
    points = points.where("x is not null and y is not null and z is not null and not isnan(z)")
    points = points.withColumns({"x": (F.col("x") + offset[0]) * scale[0], "y": (F.col("y") + offset[1]) * scale[1], "z": F.col("z") * scale[2]})
    return points.withColumn("x", (F.col("x") + 180) % 360 - 180) if wrap else points


def read_xyz(spark: SparkSession, path: str | list[str], positions: tuple = (0, 1, 2, None, None), delimiter: str | None = DELIMITER, **how) -> DataFrame:
    """``points_of_lines`` of text files; delimiter None: guessed."""
    delimiter = guess_delimiter(spark, path) if delimiter is None else delimiter
    return points_of_lines(spark.read.text(path).select("value"), positions, delimiter, **how)


def read_geojson(spark: SparkSession, path: str, z_field: str | None = None, weight_field: str | None = None, uncertainty_field: str | None = None, z_scale: float = 1.0, z: float | None = None) -> DataFrame:
    """x, y, z, w, u of the vertices of all geometries: z from the vertex, else the field, else the constant.

    Files have one feature a line or are feature collections.  Where every line is an object of its own (braces at both
    ends can't follow each other within one document), a file is read by lines, so its size doesn't matter; only a
    collection that goes over several lines is read as a whole.
    """
    feature = "struct<geometry:string,properties:map<string,string>>"
    collection = lambda v: F.from_json(v, f"struct<type:string,features:array<{feature}>>")["features"]
    file, text = F.col("_metadata.file_path").alias("file"), F.trim("value", F.lit(" \t\r\f\ufeff"))
    lines = spark.read.text(path).select(file, text.alias("value")).where("value <> ''")
    parted = [r.file for r in lines.where("not (startswith(value, '{') and endswith(value, '}'))").select("file").distinct().toLocalIterator()]  # names of files
    of_line = F.coalesce(F.when(F.contains("value", F.lit('"features"')), collection("value")), F.array(F.from_json("value", feature)))
    features = lines.where(~F.col("file").isin(parted)) if parted else lines
    features = features.select(F.explode(of_line).alias("f"))
    if parted:
        whole = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").isin(parted))
        each = F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, feature))
        features = features.unionByName(whole.select(F.explode(F.coalesce(collection("value"), each)).alias("f")))
    features = features.where("f.geometry is not null")
    # a vertex is an innermost array, whatever the geometry
    vertices = features.select("f.properties", F.explode(F.regexp_extract_all(F.get_json_object("f.geometry", "$.coordinates"), F.lit(r"\[([^\[\]]+)\]"), F.lit(1))).alias("v"))
    at = lambda i: F.get(F.split("v", r"\s*,\s*"), F.lit(i)).try_cast("double")
    prop = lambda name: F.lit(None).cast("double") if name is None else F.element_at("properties", name).try_cast("double")
    return vertices.select(at(0).alias("x"), at(1).alias("y"), (F.coalesce(at(2), prop(z_field), F.lit(z).cast("double")) * z_scale).alias("z"), prop(weight_field).alias("w"), prop(uncertainty_field).alias("u")).where("x is not null and y is not null and z is not null")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, z, x, y) of the cells with values of ESRI text grids: header lines of a name and a number, then rows."""
    lines = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("file"), F.filter(F.split(F.lower("value"), r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    is_head = lambda x: F.trim(x).rlike("^[a-z]")
    head = F.map_from_entries(F.transform(F.filter("l", is_head), lambda x: F.struct(F.split(F.trim(x), r"\s+")[0], F.split(F.trim(x), r"\s+")[1].cast("double"))))
    rows = lines.select(head.alias("h"), F.posexplode(F.filter("l", lambda x: ~is_head(x))).alias("row", "line"))
    cells = rows.select("h", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v")).withColumn("z", F.col("v").try_cast("double"))
    h = lambda name: F.element_at("h", name)
    out = cells.where(F.col("z").isNotNull() & (F.col("z") != F.coalesce(h("nodata_value"), F.lit(-9999.0))))
    return out.select("row", "col", "z", (h("xllcorner") + (F.col("col") + 0.5) * h("cellsize")).alias("x"), (h("yllcorner") + (h("nrows") - F.col("row") - 0.5) * h("cellsize")).alias("y"))


def write_xyz(points: DataFrame, path: str, delimiter: str = " ", precision: int | None = None) -> None:
    show = lambda c: F.format_string(f"%.{precision}f", c) if precision is not None else F.col(c).cast("string")
    points.select(F.concat_ws(delimiter, *(show(c) for c in ("x", "y", "z"))).alias("value")).write.text(path)


def write_ascii_grid(cells: DataFrame, grid, path: str, nodata: float = -9999, file_cells: int = 1 << 20) -> None:
    """Text grids, each with its header and whole rows of about ``file_cells`` cells: a grid of any size, whatever the order of files."""
    import numpy as np
    import pyarrow as pa

    nx, ny, size = grid.nx, grid.ny, max(1, file_cells // grid.nx)
    head = lambda n, below: [("ncols", nx), ("nrows", n), ("xllcorner", grid.x0), ("yllcorner", grid.y0 - below * grid.dy), ("cellsize", grid.dx), ("NODATA_value", nodata)]
    none = lambda kind: F.lit(None).cast(kind)
    some = cells.where(F.col("z").isNotNull() & F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1))
    some = some.select(F.floor(F.col("row") / size).alias("part"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"))
    every = cells.sparkSession.range(-(-ny // size)).select(F.col("id").alias("part"), none("long").alias("row"), none("long").alias("col"), none("double").alias("z"))

    def lines(key, table):
        first = key[0].as_py() * size
        n, t = min(size, ny - first), table.filter(table["row"].is_valid())
        z = np.full((n, nx), float(nodata))
        z[np.asarray(t["row"]) - first, np.asarray(t["col"])] = np.asarray(t["z"])
        text = [f"{k} {v}" for k, v in head(n, first + n)] + [" ".join(map(repr, r.tolist())) for r in z]
        return pa.table({"value": ["\n".join(text)]})

    some.unionByName(every).groupBy("part").applyInArrow(lines, "value string").write.option("maxRecordsPerFile", 1).text(path)  # a row a file


def geojson_points(points: DataFrame) -> DataFrame:
    """One feature a line, with weight and uncertainty."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y", "z").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("w").alias("weight"), F.col("u").alias("uncertainty")).alias("properties"))).alias("value"))


COLUMNS = ("path", "format", "weight", "uncertainty", "title", "source", "date", "type", "resolution", "horz", "vert", "url")


def parse_entry(line: str) -> dict | None:
    """Fields of a catalog line; quotes hold spaces, - is empty."""
    import shlex

    line = line.strip()
    if not line or line.startswith("#"):
        return None
    fields = shlex.split(line)
    e = {c: None if v == "-" else v for c, v in zip(COLUMNS, fields, strict=False)}
    e["weight"] = float(e.get("weight") or 1)
    e["uncertainty"] = float(e.get("uncertainty") or 0)
    e["format"] = e.get("format") or {"xyz": "168", "txt": "168", "csv": "168", "datalist": "-1", "parquet": "310", "json": "302"}.get(line.split()[0].rsplit(".", 1)[-1], "168")
    return e


def load_catalog(spark: SparkSession, path: str, weight: float = 1.0, uncertainty: float = 0.0, name: str = "") -> list[dict]:
    """Leaf entries of a catalog and of catalogs in it; weights multiply, uncertainties add in quadrature."""
    found = []
    lines = [r[0] for r in spark.read.text(path).collect()]  # a list of files, not data
    for line in lines:
        e = parse_entry(line)
        if e is None:
            continue
        where = e["path"] if "://" in e["path"] or e["path"].startswith("/") else posixpath.join(posixpath.dirname(path), e["path"])
        w, u = weight * e["weight"], (uncertainty**2 + e["uncertainty"] ** 2) ** 0.5
        title = "/".join(filter(None, (name, e.get("title") or posixpath.basename(where).rsplit(".", 1)[0])))
        if e["format"].startswith("-1"):
            found += load_catalog(spark, where, w, u, title)
        else:
            found.append(e | {"path": where, "weight": w, "uncertainty": u, "title": title})
    return found


def catalog_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Entries as a table, with the bounds of their statistics files (path + .inf) where these exist."""
    columns = (*COLUMNS, "xmin", "xmax", "ymin", "ymax", "zmin", "zmax")
    paths = [e["path"] for e in entries]
    found = {}
    if paths:
        fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        there = [p + ".inf" for p in paths if fs(p + ".inf").getFileSystem(conf).exists(fs(p + ".inf"))]
        if there:
            for name, text in spark.read.text(there, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/"), "value").toLocalIterator():
                found[name.removesuffix(".inf")] = json.loads(text)["minmax"]
    rows = [tuple(e.get(c) for c in COLUMNS) + tuple(found.get(e["path"], [None] * 6)) for e in entries]
    kinds = {"weight": "double", "uncertainty": "double"} | {c: "double" for c in columns[-6:]}
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in columns))


def prune(entries: DataFrame, region=None, weights: tuple | None = None, uncertainties: tuple | None = None, where: list[str] = ()) -> DataFrame:
    """Entries whose bounds meet the region (entries without bounds stay), with weights and uncertainties in ranges, and for which all SQL conditions hold."""
    if region is not None:
        outside = (F.col("xmax") < region.xmin) | (F.col("xmin") > region.xmax) | (F.col("ymax") < region.ymin) | (F.col("ymin") > region.ymax)
        for lo, c in ((region.zmin, F.col("zmax") < region.zmin if region.zmin is not None else None), (region.zmax, F.col("zmin") > region.zmax if region.zmax is not None else None)):
            outside = outside if lo is None else outside | c
        entries = entries.where(~F.coalesce(outside, F.lit(False)))
    for column, limits in (("weight", weights), ("uncertainty", uncertainties)):
        if limits is not None:
            entries = entries.where(F.col(column).between(*limits))
    for condition in where:
        entries = entries.where(F.expr(condition))
    return entries


def write_entry_index(entries: DataFrame, path: str) -> None:
    """One feature a line: the entry's box as a polygon, its fields as properties."""
    ring = F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin"))))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    entries.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*(F.col(f"`{c}`") for c in entries.columns)).alias("properties"))).alias("value")).write.text(path)


def read_entry_index(spark: SparkSession, path: str, region=None, **ranges) -> DataFrame:
    """Entries of an index, pruned as in ``prune``."""
    kinds = {"weight": "double", "uncertainty": "double"} | {c: "double" for c in ("xmin", "xmax", "ymin", "ymax", "zmin", "zmax")}
    shape = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in (*COLUMNS, "xmin", "xmax", "ymin", "ymax", "zmin", "zmax"))
    table = spark.read.schema(f"properties struct<{shape.replace('` ', '`:')}>").json(path).select("properties.*")
    return prune(table, region, **ranges)


def cell_index(entries: DataFrame, size: float, key: str = "path") -> DataFrame:
    """(cx, cy, key): the cells of a size that each entry's box meets."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return entries.select(key, "ymin", "ymax", span("xmin", "xmax").alias("cx")).select(key, "cx", span("ymin", "ymax").alias("cy")).select("cx", "cy", key)


def box_join(left: DataFrame, right: DataFrame, size: float, keys: tuple[str, str]) -> DataFrame:
    """Pairs of keys whose boxes intersect: both sides' cells meet in an equi-join with their boxes, and a pair counts in
    the cell of its common part's lower corner, so that none is found twice."""
    a, b = keys
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    box = lambda df, k, p: df.select(k, *(F.col(c).alias(f"{p}{c}") for c in ("xmin", "xmax", "ymin", "ymax"))).withColumn("cx", span(f"{p}xmin", f"{p}xmax")).withColumn("cy", span(f"{p}ymin", f"{p}ymax"))
    at = lambda c, v: F.col(c) == F.floor(F.greatest(f"l{v}", f"r{v}") / size)
    both = box(left, a, "l").join(box(right, b, "r"), ["cx", "cy"])
    return both.where("lxmin <= rxmax and rxmin <= lxmax and lymin <= rymax and rymin <= lymax").where(at("cx", "xmin") & at("cy", "ymin")).select(a, b)


def read_catalog(spark: SparkSession, path: str, region=None, **ranges) -> DataFrame | None:
    """All points of a catalog with source, and effective w and u; entries that can't count are never read.

    Files of one format are one scan, whatever their number; a point finds its entry by its file's name.
    """
    from ..operators.points import effective, in_region

    entries = prune(catalog_table(spark, load_catalog(spark, path)), region, **ranges).select("path", "format", "weight", "uncertainty", "title")
    by_format: dict[bool, list[str]] = {}
    for r in entries.select("path", "format").collect():  # a list of files, not data
        by_format.setdefault(r.format.startswith("310"), []).append(r.path)
    out = None
    name = F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path")
    for parquet, paths in by_format.items():
        points = spark.read.parquet(*paths).select("x", "y", "z", "w", "u", name) if parquet else points_of_lines(spark.read.text(paths).select("value", name), keep=("path",))
        if parquet:
            # an entry of Parquet is a folder
            points = points.withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
        out = points if out is None else out.unionByName(points)
    if out is None:
        return None
    out = effective(out.join(entries, "path"))
    out = out.withColumns({"w": F.col("w") * F.col("weight"), "u": F.sqrt(F.pow("u", 2) + F.pow("uncertainty", 2))}).select("x", "y", "z", "w", "u", F.col("title").alias("source"))
    return out if region is None else in_region(out, region)


def info_json(points: DataFrame, name: str) -> str:
    from ..operators.stack import statistics

    s = statistics(points).first().asDict()
    return json.dumps({"name": name, "numpts": s["numpts"], "minmax": [s[f"{c}{m}"] for c in "xyz" for m in ("min", "max")]})
