"""Scalar functions on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0
METERS_PER_DEGREE = 111_319.49079327358


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def to_number(c: Column, kind: str = "double") -> Column:
    return F.expr("1") if c is None else c.try_cast(kind)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6_378_137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = 6_378_137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)


def number_range(c: Column) -> Column:
    """The numbers in a string as min-max."""
    n = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return F.when(F.size(n) > 0, F.concat_ws("-", F.array_min(n).cast("string"), F.array_max(n).cast("string")))


#: accented Latin letters and what they fold to
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def slug(c: Column) -> Column:
    """Lower case without accents; words joined by single dashes, none at the ends."""
    plain = F.translate(F.lower(F.trim(c)), ACCENTED, PLAIN)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9_\s-]", ""), r"[\s_-]+", "-"), "^-+|-+$", "")


#: metres of a degree at the equator
DEGREE = 111321.543


def degree_lengths(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of longitude and of latitude."""
    return F.cos(F.radians(lat)) * DEGREE, F.lit(DEGREE)


def increment_metres(inc: Column) -> Column:
    """An increment in degrees as metres."""
    return F.cos(F.radians(inc)) * DEGREE * inc


def consecutive_ranges(values: Column) -> Column:
    """An array of whole numbers as an array of structs (first, last) of consecutive runs."""
    start = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def step(runs, v):
        last = F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["first"].alias("first"), v.cast("long").alias("last"))))
        new = F.concat(runs, F.array(F.struct(v.cast("long").alias("first"), v.cast("long").alias("last"))))
        return F.when((F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["last"] >= v - 1), grown).otherwise(new)

    return F.aggregate(F.array_sort(F.array_distinct(values)), start, step)


def box_wkt(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    p = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(",", p(xmin, ymin), p(xmin, ymax), p(xmax, ymax), p(xmax, ymin), p(xmin, ymin)), F.lit("))"))
