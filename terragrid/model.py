"""Regions, grid specifications and module strings."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """A box; bounds of z, w and u are optional."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    zmin: float | None = None
    zmax: float | None = None
    wmin: float | None = None
    wmax: float | None = None
    umin: float | None = None
    umax: float | None = None

    @staticmethod
    def parse(text: str) -> "Region":
        """``-R`` or plain ``xmin/xmax/ymin/ymax[/zmin/zmax[/wmin/wmax[/umin/umax]]]``, POLYGON text or GeoJSON; - stands for no bound."""
        text = text.strip()
        if text.startswith("{"):
            shape = json.loads(text)
            ring = (shape.get("geometry") or shape)["coordinates"][0]
            return Region._around(ring)
        if text.upper().startswith("POLYGON"):
            return Region._around([tuple(map(float, p.split()[:2])) for p in text[text.rindex("(") + 1 : text.index(")")].split(",")])
        return Region(*(None if v in ("-", "None", "") else float(v) for v in text.removeprefix("-R").split("/")))

    @staticmethod
    def _around(ring) -> "Region":
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        return Region(min(xs), max(xs), min(ys), max(ys))

    @property
    def valid(self) -> bool:
        return self.xmin < self.xmax and self.ymin < self.ymax and all(lo is None or hi is None or lo <= hi for lo, hi in ((self.zmin, self.zmax), (self.wmin, self.wmax), (self.umin, self.umax)))

    def _with(self, other: "Region", lower, upper) -> "Region":
        """Bounds of both; where only one has a bound, that one."""
        def pick(name, f):
            a, b = getattr(self, name), getattr(other, name)
            return b if a is None else a if b is None else f(a, b)

        return Region(**{f"{c}{m}": pick(f"{c}{m}", f) for c in "xyzwu" for m, f in (("min", lower), ("max", upper))})

    def intersect(self, other: "Region") -> "Region":
        return self._with(other, max, min)

    def union(self, other: "Region") -> "Region":
        return self._with(other, min, max)

    def intersects(self, other: "Region") -> bool:
        return self.intersect(other).valid

    def within(self, other: "Region") -> bool:
        return other.xmin <= self.xmin and self.xmax <= other.xmax and other.ymin <= self.ymin and self.ymax <= other.ymax

    def buffer(self, by: float, inc: float | None = None) -> "Region":
        """Grown on all sides; inc: by whole increments."""
        by = by if inc is None else int(by / inc) * inc
        return replace(self, xmin=self.xmin - by, xmax=self.xmax + by, ymin=self.ymin - by, ymax=self.ymax + by)

    def buffer_percent(self, percent: float, inc: float | None = None) -> "Region":
        return self.buffer(((self.xmax - self.xmin) + (self.ymax - self.ymin)) / 2 * percent / 100, inc)

    def cut(self, to: "Region", dx: float | None = None, dy: float | None = None) -> "Region":
        """Shrunk to another region, by whole increments if given; itself where they don't meet or it lies around nothing new."""
        if not (self.valid and to.valid and self.intersects(to)):
            return self
        if dx is None or dy is None:
            return self.intersect(to)
        less = lambda a, b, d: a - int((a - b) / d) * d
        return replace(self, xmin=less(self.xmin, to.xmin, dx), xmax=less(self.xmax, to.xmax, dx), ymin=less(self.ymin, to.ymin, dy), ymax=less(self.ymax, to.ymax, dy))

    @property
    def centre(self) -> tuple[float, float]:
        return (self.xmin + self.xmax) / 2, (self.ymin + self.ymax) / 2

    def increments(self, nx: int, ny: int) -> tuple[float, float]:
        return (self.xmax - self.xmin) / nx, (self.ymax - self.ymin) / ny

    def on_earth(self, just_below: bool = False) -> "Region":
        """Bounds beyond 180 and 90 degrees taken back to these, or to a little less."""
        off = 0.15 if just_below else 0.0
        low = lambda v, end: -end + off if v <= -end else v
        high = lambda v, end: end - off if v >= end else v
        return replace(self, xmin=low(self.xmin, 180), xmax=high(self.xmax, 180), ymin=low(self.ymin, 90), ymax=high(self.ymax, 90))

    def rounded(self, digits: int) -> "Region":
        return replace(self, xmin=round(self.xmin, digits), xmax=round(self.xmax, digits), ymin=round(self.ymin, digits), ymax=round(self.ymax, digits))

    def tiles(self, size: float) -> list["Region"]:
        nx, ny = (math.ceil((b - a) / size - 1e-9) for a, b in ((self.xmin, self.xmax), (self.ymin, self.ymax)))
        return [Region(self.xmin + i * size, self.xmin + (i + 1) * size, self.ymin + j * size, self.ymin + (j + 1) * size) for i in range(nx) for j in range(ny)]

    def wkt(self) -> str:
        a, b, c, d = self.xmin, self.xmax, self.ymin, self.ymax
        return f"POLYGON (({a:g} {c:g},{a:g} {d:g},{b:g} {d:g},{b:g} {c:g},{a:g} {c:g}))"

    def format(self, kind: str = "gmt") -> str:
        a, b, c, d = self.xmin, self.xmax, self.ymin, self.ymax
        return {
            "gmt": f"-R{a:g}/{b:g}/{c:g}/{d:g}",
            "str": f"{a:g}/{b:g}/{c:g}/{d:g}",
            "bbox": f"{a:g},{c:g},{b:g},{d:g}",
            "te": f"{a:g} {c:g} {b:g} {d:g}",
            "ul_lr": f"{a:g} {d:g} {b:g} {c:g}",
            "wkt": self.wkt(),
            "sstr": f"{a:g} {b:g} {c:g} {d:g}",
            "fstr": f"{'w' if a < 0 else 'e'}{abs(a):g}_{'s' if c < 0 else 'n'}{abs(c):g}",
            "xyz": "\n".join(f"{x:g} {y:g}" for x, y in ((a, c), (a, d), (b, d), (b, c), (a, c))),
        }[kind]

    def geojson(self) -> dict:
        a, b, c, d = self.xmin, self.xmax, self.ymin, self.ymax
        return {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[a, c], [a, d], [b, d], [b, c], [a, c]]]}}

    def holds(self, x: str = "x", y: str = "y", z: str = "z") -> Column:
        """Inclusive membership; a predicate that reaches the scan."""
        test = F.col(x).between(self.xmin, self.xmax) & F.col(y).between(self.ymin, self.ymax)
        if self.zmin is not None:
            test &= F.col(z) >= self.zmin
        if self.zmax is not None:
            test &= F.col(z) <= self.zmax
        return test


@dataclass(frozen=True)
class Grid:
    """Origin at the upper left; rows go down."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int

    @staticmethod
    def of(region: Region, dx: float, dy: float | None = None) -> "Grid":
        dy = dy or dx
        size = lambda a, b, d: math.floor((b - a) / d + 0.5)
        return Grid(region.xmin, region.ymax, dx, dy, size(region.xmin, region.xmax, dx), size(region.ymin, region.ymax, dy))

    def col(self, x="x") -> Column:
        return F.floor((F.col(x) - self.x0) / self.dx).cast("int")

    def row(self, y="y") -> Column:
        return F.floor((F.lit(self.y0) - F.col(y)) / self.dy).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.ny - 1) & col.between(0, self.nx - 1)

    def x(self, col="col") -> Column:
        return F.lit(self.x0) + (F.col(col) + 0.5) * self.dx

    def y(self, row="row") -> Column:
        return F.lit(self.y0) - (F.col(row) + 0.5) * self.dy


def increment(text: str | float) -> float:
    """Number with a unit: s or c for arc-seconds, m for arc-minutes."""
    text = str(text).strip()
    unit = {"s": 3600, "c": 3600, "m": 60}.get(text[-1:])
    return float(text[:-1]) / unit if unit else float(text)


_PART = re.compile(r'((?:[^:"]|"[^"]*")+)')


def _value(text: str):
    text = text.strip('"')
    if text.lower() in ("true", "false", "none"):
        return {"true": True, "false": False, "none": None}[text.lower()]
    if ";" in text:
        return [_value(v) for v in text.split(";")]
    try:
        return int(text)
    except ValueError:
        pass
    try:
        return float(text)
    except ValueError:
        return text


@dataclass
class Registry:
    """Named operators, called by strings like ``idw:power=2:k=8``."""

    kind: str
    found: dict = field(default_factory=dict)

    def add(self, name: str, function=None):
        if function is None:
            return lambda f: self.add(name, f)
        self.found[name] = function
        return function

    def parse(self, text: str) -> tuple[str, dict]:
        name, *parts = _PART.findall(text)
        return name, {k: _value(v) for k, _, v in (p.partition("=") for p in parts)}

    def text(self, name: str, args: dict) -> str:
        show = lambda v: ";".join(map(str, v)) if isinstance(v, (list, tuple)) else f'"{v}"' if isinstance(v, str) and re.search("[:=]", v) else str(v)
        return ":".join([name, *(f"{k}={show(v)}" for k, v in args.items())])

    def apply(self, df, text: str, **more):
        name, args = self.parse(text)
        if name not in self.found:
            raise KeyError(f"no {self.kind} is called {name!r}")
        return self.found[name](df, **(args | more))
