"""Interpolation of stacks to grids.

Searches go by square tiles.  Data are sent to the tiles that they can count for: with a radius to those it
touches, without one as packed tiles to those that can't rule them out by distance.  A tile's cells are worked out
beside each other in arrays and only results leave it.  A ``Whole`` grid isn't sent at all: tiles make their cells.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Registry
from ..tables import settle

MODULES = Registry("gridding module")

#: cells on a side of a tile of data, and of one of cells
PACK, TILE = 128, 256
#: cells from which a box's nearest are told candidate by candidate, not cell by cell
LARGE = 1024
#: rows and columns of a block of cells that adds up the discs of natural neighbours; from so many blocks on they are wider, up to so many cells
BLOCK, BLOCKS, BLOCK_CELLS = (64, 4096), 256, 1 << 22


@dataclass(frozen=True)
class Whole:
    """All cells of ny rows and nx columns."""

    ny: int
    nx: int


def targets(spark, ny: int, nx: int) -> DataFrame:
    return spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))


def _values(data: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("weights").cast("double"), F.lit(0.0)) if "weights" in data.columns else F.lit(1.0)
    return data.where("z is not null").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"), weight.alias("w"))


def _tile(c: str, side: int) -> Column:
    return F.floor(F.col(c) / side).alias(f"t{c[0]}")


def _asked(cells: DataFrame | Whole, spark, side: int) -> DataFrame:
    """(tr, tc, row, col) of cells by tile; of a whole grid, one row without row and col for each tile."""
    if isinstance(cells, Whole):
        down, across = -(-cells.ny // side), -(-cells.nx // side)
        none = F.lit(None).cast("long")
        return spark.range(down * across).select(F.floor(F.col("id") / across).alias("tr"), (F.col("id") % across).alias("tc"), none.alias("row"), none.alias("col"))
    return cells.select(_tile("row", side), _tile("col", side), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


def _layers(r, c, z, w, shape):
    """Arrays (there, z, w) of data at places; more than one where places repeat."""
    at = np.ravel_multi_index((r, c), shape)
    out = []
    while len(at):
        _, first = np.unique(at, return_index=True)
        there, zs, ws = np.zeros(shape, bool), np.zeros(shape), np.zeros(shape)
        there.flat[at[first]], zs.flat[at[first]], ws.flat[at[first]] = True, z[first], w[first]
        out.append((there, zs, ws))
        rest = np.ones(len(at), bool)
        rest[first] = False
        at, z, w = at[rest], z[rest], w[rest]
    return out


def _offsets(radius: int):
    """(d2, dr, dc) within a radius, the nearest first, ties by row and column."""
    r = range(-radius, radius + 1)
    return sorted((i * i + j * j, i, j) for i in r for j in r if i * i + j * j <= radius * radius)


def _focal(cells: DataFrame | Whole | None, data: DataFrame, radius: int, kernel, schema: str) -> DataFrame:
    """What ``kernel(layers, view, wanted, rows, cols)`` yields for each tile.

    ``layers`` reach ``radius`` beyond the tile, ``view(a, dr, dc)`` is an array's part at an offset from the tile's
    cells, ``wanted`` marks those asked for.  Cells None: those with data.
    """
    spark, side, d = data.sparkSession, max(TILE, 2 * radius), _values(data)
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side)))
    sent = d.select(near("row").alias("tr"), "*").select("tr", near("col").alias("tc"), "row", "col", "z", "w")
    rows = sent
    if cells is not None:
        rows = sent.unionByName(_asked(cells, spark, side).withColumns({"z": F.lit(None).cast("double"), "w": F.lit(None).cast("double")}))
    whole, some = (cells.ny, cells.nx) if isinstance(cells, Whole) else None, cells is not None

    def solve(key, table):
        tr, tc = key[0].as_py(), key[1].as_py()
        row, col = (np.asarray(table[c].fill_null(0)) for c in ("row", "col"))
        z, w = (np.asarray(table[c].fill_null(0.0)) for c in ("z", "w"))
        is_data = np.asarray(table["w"].is_valid())
        shape = (side + 2 * radius,) * 2
        r, c = row - tr * side, col - tc * side
        layers = _layers(r[is_data] + radius, c[is_data] + radius, z[is_data], w[is_data], shape)
        wanted = np.zeros((side, side), bool)
        if whole:
            wanted[: max(0, whole[0] - tr * side), : max(0, whole[1] - tc * side)] = np.asarray(table["row"].is_null()).any()
        elif some:
            wanted[r[~is_data], c[~is_data]] = True
        view = lambda a, dr, dc: a[radius + dr : radius + dr + side, radius + dc : radius + dc + side]
        return kernel(layers, view, wanted, np.arange(side) + tr * side, np.arange(side) + tc * side)

    return rows.groupBy("tr", "tc").applyInArrow(solve, schema)


def _cells_of(got, values, rows, cols, name: str = "z") -> pa.Table:
    i, j = np.nonzero(got)
    return pa.table({"row": pa.array(rows[i], pa.int32()), "col": pa.array(cols[j], pa.int32()), name: pa.array(values[i, j], pa.float64())})


def _blob(*columns) -> bytes:
    """Columns of whole numbers and doubles in 8 bytes each."""
    return zlib.compress(b"".join(np.asarray(x, f"<{x.dtype.kind}8").tobytes() for x in columns), 1)


def _columns(blob: bytes, kinds: str) -> list:
    raw = zlib.decompress(blob)
    n = len(raw) // (8 * len(kinds))
    return [np.frombuffer(raw, f"<{t}8", n, n * 8 * i) for i, t in enumerate(kinds)]


def _pack(d: DataFrame) -> DataFrame:
    """(sr, sc, n, r0, r1, c0, c1, blob): the data of each tile of ``PACK`` cells, in order of rows and columns."""

    def pack(key, t):
        r, c, z, w = (np.asarray(t[x]) for x in ("row", "col", "z", "w"))
        order = np.lexsort((c, r))
        r, c, z, w = r[order], c[order], z[order], w[order]
        return pa.table({"sr": [key[0].as_py()], "sc": [key[1].as_py()], "n": [len(r)], "r0": [r.min()], "r1": [r.max()], "c0": [c.min()], "c1": [c.max()], "blob": pa.array([_blob(r, c, z, w)], pa.binary())})

    keyed = d.select(_tile("row", PACK).alias("sr"), _tile("col", PACK).alias("sc"), "*")
    return keyed.groupBy("sr", "sc").applyInArrow(pack, "sr long, sc long, n long, r0 long, r1 long, c0 long, c1 long, blob binary")


def _spans(lo, hi, at0, at1):
    """Least and largest distance along an axis of spans lo .. hi from at0 .. at1."""
    return np.maximum(0, np.maximum(lo - at1, at0 - hi)), np.maximum(hi - at0, at1 - lo)


def _undominated(r0: int, r1: int, c0: int, c1: int, r, c):
    """Marks data that no other one is nearer than in the whole box, of those nearest to its corners or middle.

    The difference of two squared distances is linear in the cell, so its least value is at a corner.
    """
    d = (r[:, None] - np.array([r0, r0, r1, r1])) ** 2 + (c[:, None] - np.array([c0, c1, c0, c1])) ** 2
    keep = np.ones(len(d), bool)
    for j in {*d.argmin(axis=0).tolist(), int(d.sum(axis=1).argmin())}:
        keep &= (d <= d[j]).any(axis=1)
    return keep


def _boxes(r0: int, r1: int, c0: int, c1: int, r, c, k: int):
    """(rows, cols, candidates): boxes of cells with all data that may be among the k nearest of some of their cells.

    A cell's k nearest lie within its box's radius twice, and the k-th distance from its centre, of that centre.
    """
    todo = [(r0, r1, c0, c1, np.arange(len(r)))]
    while todo:
        r0, r1, c0, c1, cand = todo.pop()
        if len(cand) > k:
            d = np.hypot(r[cand] - (r0 + r1) / 2, c[cand] - (c0 + c1) / 2)
            reach = np.partition(d, k - 1)[k - 1] + np.hypot(r1 - r0, c1 - c0) + 1e-6
            cand = cand[d <= reach]
            if k == 1:
                cand = cand[_undominated(r0, r1, c0, c1, r[cand], c[cand])]
        few = len(cand) <= 4 * k + 12 and (k == 1 or (r1 - r0 + 1) * (c1 - c0 + 1) * len(cand) <= 1 << 19)
        if few or (r1 - r0 < 8 and c1 - c0 < 8):
            yield np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), cand
            continue
        for a, b in ((r0, (r0 + r1) // 2), ((r0 + r1) // 2 + 1, r1)):
            for e, f in ((c0, (c0 + c1) // 2), ((c0 + c1) // 2 + 1, c1)):
                if a <= b and e <= f:
                    todo.append((a, b, e, f, cand))


def _first_nearest(in_rows, in_cols):
    """(places, squared distances) of the nearest candidates of a box's cells, the first of equals; a line a candidate in both."""
    best = in_rows[0][:, None] + in_cols[0]
    at, d, less = np.zeros(best.shape, "i4"), np.empty_like(best), np.empty(best.shape, bool)
    for i in range(1, len(in_rows)):
        np.add(in_rows[i][:, None], in_cols[i], out=d)
        np.less(d, best, out=less)
        np.copyto(at, i, where=less)
        np.minimum(best, d, out=best)
    return at, best


def _nearest(cells: DataFrame | Whole, data: DataFrame, k: int, finish, schema: str, radius: int | None = None, close=None, closed: str = "") -> DataFrame:
    """What ``finish(row, col, near, d2, r, c, z, w)`` makes of cells with their k nearest data, ties by row and column.

    ``near`` has the places of the nearest in r, c, z, w, a line a cell, and d2 their squared distances; -1 beyond
    the radius.  Without a radius the search has no bound.  A tile of cells gets the packed tiles of data
    that aren't further than the furthest corner of those nearer ones which have k data.  ``close`` makes another
    table, of schema ``closed``, of a tile's.
    """
    spark = data.sparkSession
    packed = settle(_pack(_values(data)), "packed")
    # a row for each tile with data
    known = np.array([tuple(x) for x in packed.select("sr", "sc", "n", "r0", "r1", "c0", "c1").toLocalIterator()], "i8").reshape(-1, 7)
    whole = (cells.ny, cells.nx) if isinstance(cells, Whole) else None
    asked = _asked(cells, spark, TILE)
    tiles = asked.select("tr", "tc") if whole else asked.select("tr", "tc").distinct()

    def pair(batch_iter):
        sr, sc, n, r0, r1, c0, c1 = known.T
        for b in batch_iter:
            out = [[], [], [], []]
            for tr, tc in zip(*(b[x].to_pylist() for x in ("tr", "tc")), strict=True):
                (near_r, far_r), (near_c, far_c) = _spans(r0, r1, tr * TILE, tr * TILE + TILE - 1), _spans(c0, c1, tc * TILE, tc * TILE + TILE - 1)
                near, far = near_r**2 + near_c**2, far_r**2 + far_c**2
                order = np.argsort(far)
                enough = np.searchsorted(np.cumsum(n[order]), k)
                bound = far[order[enough]] if enough < len(n) else np.iinfo("i8").max
                need = np.flatnonzero(near <= (bound if radius is None else min(bound, radius * radius)))
                for o, v in zip(out, (np.full(len(need), tr), np.full(len(need), tc), sr[need], sc[need]), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o or [np.zeros(0, "i8")]), pa.int64()) for o in out], ["tr", "tc", "sr", "sc"])

    none = F.lit(None).cast("long")
    pairs = tiles.mapInArrow(pair, "tr long, tc long, sr long, sc long")
    rows = pairs.join(packed.select("sr", "sc", "blob").hint("merge"), ["sr", "sc"]).select("tr", "tc", none.alias("row"), none.alias("col"), "blob")
    if not whole:
        rows = rows.unionByName(asked.withColumn("blob", F.lit(None).cast("binary")))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    kinds = [kinds[x.split()[1]] for x in schema.split(", ")]

    def solve(key, table):
        tr, tc = key[0].as_py() * TILE, key[1].as_py() * TILE
        parts = [_columns(blob, "iiff") for blob in table["blob"].drop_null().to_pylist()]
        out = [[] for _ in names]
        if parts:
            r, c, z, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((c, r))
            r, c, z, w = r[order], c[order], z[order], w[order]
            if whole:
                wanted, box = None, (tr, min(tr + TILE, whole[0]) - 1, tc, min(tc + TILE, whole[1]) - 1)
            else:
                row, col = (np.asarray(table[x].drop_null()) for x in ("row", "col"))
                wanted = np.zeros((TILE, TILE), bool)
                wanted[row - tr, col - tc] = True
                box = (row.min(), row.max(), col.min(), col.max()) if len(row) else (1, 0, 1, 0)
            for rows_, cols_, cand in _boxes(*box, r, c, k) if box[0] <= box[1] else ():
                m = len(cand)
                if wanted is not None and not wanted[rows_[0] - tr : rows_[-1] - tr + 1, cols_[0] - tc : cols_[-1] - tc + 1].any():
                    continue
                in_rows, in_cols = (rows_ - r[cand][:, None]) ** 2, (cols_ - c[cand][:, None]) ** 2
                large = k == 1 and len(rows_) * len(cols_) >= LARGE
                if large:
                    near, d2 = (x.reshape(-1, 1) for x in _first_nearest(in_rows, in_cols))
                else:
                    d2 = (in_rows.T[:, None, :] + in_cols.T[None, :, :]).reshape(-1, m)
                row, col = np.repeat(rows_, len(cols_)), np.tile(cols_, len(rows_))
                if wanted is not None:
                    some = wanted[row - tr, col - tc]
                    d2, row, col = d2[some], row[some], col[some]
                    if not len(row):
                        continue
                    near = near[some] if large else None
                if large:
                    pass
                elif k == 1:
                    near = d2.argmin(axis=1)[:, None]
                    d2 = np.take_along_axis(d2, near, 1)
                else:
                    mixed = d2 * m + np.arange(m)
                    mixed = np.sort(np.partition(mixed, k - 1, axis=1)[:, :k] if m > k else mixed, axis=1)
                    near, d2 = mixed % m, mixed // m
                if radius is not None:
                    d2 = np.where(d2 <= radius * radius, d2, -1)
                    some = d2[:, 0] >= 0
                    near, d2, row, col = near[some], d2[some], row[some], col[some]
                if len(row):
                    for o, v in zip(out, finish(row, col, cand[near], d2, r, c, z, w), strict=True):
                        o.append(v)
        found = pa.table([pa.array(np.concatenate(o) if o else np.zeros(0), t) if o else pa.array([], t) for o, t in zip(out, kinds, strict=True)], names=names)
        return close(found) if close else found

    return rows.groupBy("tr", "tc").applyInArrow(solve, closed or schema)


def k_nearest(cells: DataFrame | Whole, data: DataFrame, k: int, radius: int | None = None) -> DataFrame:
    """Cells with their k nearest data (row, col, nr, nc, nz, nw, d2); ties by row and column.  Without a radius the search has no bound."""

    def finish(row, col, near, d2, r, c, z, w):
        ok = d2 >= 0
        per = ok.sum(axis=1)
        return np.repeat(row, per), np.repeat(col, per), r[near[ok]], c[near[ok]], z[near[ok]], w[near[ok]], d2[ok].astype(float)

    return _nearest(cells, data, k, finish, "row int, col int, nr int, nc int, nz double, nw double, d2 double", radius)


@MODULES.add("idw")
def idw(cells: DataFrame | Whole, data: DataFrame, power: float = 1, k: int = 8, radius: int | None = None) -> DataFrame:
    """Weighted mean of the k nearest; data cells keep their value."""

    def finish(row, col, near, d2, r, c, z, w):
        far = d2 > 0
        weight = np.where(far, w[near] / np.where(far, d2, 1) ** (power / 2), 0.0)
        own = np.where(d2 == 0, z[near], -np.inf).max(axis=1)
        total = weight.sum(axis=1)
        mean = np.where(far, weight * z[near], 0.0).sum(axis=1) / np.where(total != 0, total, 1)
        return row, col, np.where((d2 == 0).any(axis=1), own, mean)

    return _nearest(cells, data, k, finish, "row int, col int, z double", radius)


@MODULES.add("nearest")
def nearest(cells: DataFrame | Whole, data: DataFrame, radius: int | None = None) -> DataFrame:
    return _nearest(cells, data, 1, lambda row, col, near, d2, r, c, z, w: (row, col, z[near[:, 0]]), "row int, col int, z double", radius)


@MODULES.add("average")
def average(cells: DataFrame | Whole, data: DataFrame, radius: int = 2, min_points: int = 1) -> DataFrame:
    def kernel(layers, view, wanted, rows, cols):
        n, total = np.zeros(wanted.shape, int), np.zeros(wanted.shape)
        for there, z, _ in layers:
            for _, i, j in _offsets(radius):
                n += view(there, i, j)
                total += view(z, i, j)
        got = wanted & (n >= max(1, min_points))
        return _cells_of(got, total / np.maximum(n, 1), rows, cols)

    return _focal(cells, data, radius, kernel, "row int, col int, z double")


@MODULES.add("invdst")
def inverse_distance(cells: DataFrame | Whole, data: DataFrame, power: float = 2, smoothing: float = 0, radius: int = 2) -> DataFrame:
    def kernel(layers, view, wanted, rows, cols):
        n, total, weight, own = np.zeros(wanted.shape, int), np.zeros(wanted.shape), np.zeros(wanted.shape), np.full(wanted.shape, -np.inf)
        for there, z, _ in layers:
            for d2, i, j in _offsets(radius):
                here = view(there, i, j)
                n += here
                if d2 + smoothing > 0:
                    w = 1 / np.sqrt(d2 + smoothing * smoothing) ** power
                    total += w * view(z, i, j)
                    weight += w * here
                else:
                    own = np.where(here, np.maximum(own, view(z, i, j)), own)
        mean = total / np.where(weight > 0, weight, 1)
        return _cells_of(wanted & (n > 0), np.where(own > -np.inf, own, mean), rows, cols)

    return _focal(cells, data, radius, kernel, "row int, col int, z double")


@MODULES.add("nearneighbor")
def near_neighbor(cells: DataFrame | Whole, data: DataFrame, radius: int = 5, sectors: int = 4) -> DataFrame:
    """The nearest of each sector, weighted 1 / (1 + 9 d^2 / R^2)."""

    def kernel(layers, view, wanted, rows, cols):
        found = np.zeros((sectors, *wanted.shape), bool)
        total, weight = np.zeros(wanted.shape), np.zeros(wanted.shape)
        for d2, i, j in _offsets(radius):
            s = int(np.floor((np.arctan2(i, j) + np.pi) / (2 * np.pi) * sectors)) % sectors
            w = 1 / (1 + 9 * d2 / (radius * radius))
            for there, z, _ in layers:
                new = view(there, i, j) & ~found[s]
                total[new] += w * view(z, i, j)[new]
                weight[new] += w
                found[s] |= new
        got = wanted & found.any(axis=0)
        return _cells_of(got, total / np.where(weight > 0, weight, 1), rows, cols)

    return _focal(cells, data, radius, kernel, "row int, col int, z double")


def _parts(z):
    """(units, parts): whole numbers below 2^20 of each unit that make up z, so that their sums are exact; NaN and infinities are units too."""
    units, parts, rest = [], [], np.where(np.isfinite(z), z, 0.0)
    for v, same in ((np.nan, np.isnan(z)), (np.inf, z == np.inf), (-np.inf, z == -np.inf)):
        if same.any():
            units.append(v)
            parts.append(same.astype(float))
    while rest.any():
        units.append(2.0 ** max(-1074, (int(np.frexp(np.abs(rest).max())[1]) - 1) // 20 * 20))
        parts.append(np.trunc(rest / units[-1]))
        rest = rest - parts[-1] * units[-1]
    return units, np.array(parts).reshape(len(units), len(z))


@MODULES.add("natural-neighbor")
def natural_neighbor(cells: DataFrame | Whole, data: DataFrame) -> DataFrame:
    """Discrete natural neighbours: every cell gives the z of its nearest datum to all cells within that distance; a cell is the mean of what it gets.

    ``cells`` must be the whole grid, as each of its cells takes part.  Tiles send runs of cells with one nearest
    datum to the blocks that their discs reach; a block adds up where a disc begins and ends in each of its rows.
    """
    high, wide = BLOCK
    if isinstance(cells, Whole):
        area = (0, cells.ny - 1, 0, cells.nx - 1)
    else:
        area = tuple(cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first())
        area = (0, -1, 0, -1) if None in area else area
    blocks = lambda: (area[1] // high - area[0] // high + 1) * (area[3] // wide - area[2] // wide + 1)
    while blocks() > BLOCKS and wide < area[3] - area[2] and high * wide < BLOCK_CELLS:
        wide *= 2

    def send(table):
        row, col, nr, nc, z = (np.asarray(x) for x in table.columns)
        out = []
        if len(row):
            order = np.lexsort((col, row))
            row, col, nr, nc, z = (x[order] for x in (row, col, nr, nc, z))
            other = (np.diff(row) != 0) | (np.diff(col) != 1) | (np.diff(nr) != 0) | (np.diff(nc) != 0)
            at = np.flatnonzero(np.concatenate(([True], other)))
            n = np.diff(np.append(at, len(row)))
            reach = np.sqrt(np.maximum.reduceat((row - nr) ** 2 + (col - nc) ** 2, at)).astype("i8")
            row, col, nr, nc, z = (x[at] for x in (row, col, nr, nc, z))
            for i in range(max(area[0], (row - reach).min()) // high, min(area[1], (row + reach).max()) // high + 1):
                some = np.flatnonzero((row + reach >= i * high) & (row - reach < i * high + high))
                if not len(some):
                    continue
                first, last = (col - reach)[some].min(), (col + n - 1 + reach)[some].max()
                # differences of neighbours are mostly small
                blob = _blob(*(np.diff(x[some], prepend=0) for x in (row, col)), n[some], (nr - row)[some], (nc - col)[some], z[some])
                out += [(i, j, blob) for j in range(max(area[2], first) // wide, min(area[3], last) // wide + 1)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["br", "bc", "blob"])

    def add(key, table):
        top, left = key[0].as_py() * high, key[1].as_py() * wide
        runs = [(np.cumsum(row), np.cumsum(col), n, nr, nc, z) for row, col, n, nr, nc, z in (_columns(blob, "iiiiif") for blob in table["blob"].to_pylist())]
        row, col, n, nr, nc, z = (np.concatenate(x) for x in zip(*runs, strict=True))
        units, parts = _parts(z)
        sums, asked = np.zeros((len(units) + 1, high, wide + 1)), np.zeros((high, wide), bool)
        order = np.argsort(row, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
            r, many = row[own[0]], n[own]
            of = np.repeat(own, many)
            ahead = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            c = col[of] + ahead
            d2 = (nr[of] ** 2 + (nc[of] - ahead) ** 2).astype(float)
            if top <= r < top + high:
                asked[r - top, c[(c >= left) & (c < left + wide)] - left] = True
            order_d = np.argsort(-d2)
            d2, c, w = d2[order_d], c[order_d] - left, parts[:, of[order_d]]
            reach = int(np.sqrt(d2[0]))
            for i in range(max(0, r - reach - top), min(high, r + reach - top + 1)):
                up = (top + i - r) ** 2
                m = np.searchsorted(-d2, -up, "right")
                s = np.sqrt(d2[:m] - up).astype("i8")
                begin, end = c[:m] - s, c[:m] + s
                end += 1
                for x in (begin, end):
                    np.maximum(x, 0, out=x)
                    np.minimum(x, wide, out=x)
                sums[-1, i] += np.bincount(begin, minlength=wide + 1) - np.bincount(end, minlength=wide + 1)
                for k in range(len(units)):
                    sums[k, i] += np.bincount(begin, w[k, :m], wide + 1) - np.bincount(end, w[k, :m], wide + 1)
        got = np.cumsum(sums, axis=2)[:, :, :wide]
        total = np.zeros((high, wide))
        with np.errstate(invalid="ignore", over="ignore"):
            for unit, x in zip(units, got, strict=False):
                total += x * unit if np.isfinite(unit) else np.where(x > 0, unit, 0)
            total /= np.maximum(got[-1], 1)
        return _cells_of(asked, total, np.arange(high) + top, np.arange(wide) + left)

    finish = lambda row, col, near, d2, r, c, z, w: (row, col, r[near[:, 0]], c[near[:, 0]], z[near[:, 0]])
    sent = _nearest(cells, data, 1, finish, "row long, col long, nr long, nc long, z double", close=send, closed="br long, bc long, blob binary")
    # a block's work isn't in proportion to its bytes, so a number is named
    return sent.repartition(max(1, min(blocks(), 512)), "br", "bc").groupBy("br", "bc").applyInArrow(add, "row int, col int, z double")


@MODULES.add("kriging")
def kriging(cells: DataFrame | Whole, data: DataFrame, k: int = 12, model: str = "spherical", nugget: float = 0.0, sill: float = 1.0, reach: float = 10.0) -> DataFrame:
    """(row, col, z, variance) by ordinary kriging from the k nearest data with a given variogram.

    Each cell's small system is solved beside those of its batch; data cells keep their value without a nugget.
    """
    def gamma(h):
        t = np.minimum(h / reach, 1)
        shape = {"spherical": 1.5 * t - 0.5 * t**3, "linear": t, "exponential": 1 - np.exp(-3 * h / reach), "gaussian": 1 - np.exp(-3 * (h / reach) ** 2)}[model]
        return np.where(h > 0, nugget + (sill - nugget) * shape, 0.0)

    def finish(row, col, near, d2, r, c, z, w):
        n, m = near.shape
        r_, c_ = r[near], c[near]
        a = np.ones((n, m + 1, m + 1))
        a[:, :m, :m] = gamma(np.hypot(r_[:, :, None] - r_[:, None, :], c_[:, :, None] - c_[:, None, :]))
        a[:, m, m] = 0
        b = np.ones((n, m + 1, 1))
        b[:, :m, 0] = gamma(np.sqrt(d2))
        x = np.linalg.solve(a, b)[:, :, 0]
        return row, col, (x[:, :m] * z[near]).sum(axis=1), (x * b[:, :, 0]).sum(axis=1)

    return _nearest(cells, data, k, finish, "row int, col int, z double, variance double")


@MODULES.add("ml-knn")
def knn_mean(cells: DataFrame | Whole, data: DataFrame, k: int = 5) -> DataFrame:
    """Plain mean of the k nearest data."""
    return _nearest(cells, data, k, lambda row, col, near, d2, r, c, z, w: (row, col, z[near].mean(axis=1)), "row int, col int, z double")


def proximity(cells: DataFrame | Whole, data: DataFrame, radius: int | None = None) -> DataFrame:
    """Distance in cells to the nearest data cell; null beyond a radius, if one is given."""
    if radius is None:
        d = _nearest(cells, data, 1, lambda row, col, near, d2, r, c, z, w: (row, col, np.sqrt(d2[:, 0])), "row int, col int, distance double")
        every = targets(data.sparkSession, cells.ny, cells.nx) if isinstance(cells, Whole) else cells.select("row", "col")
        return every.join(d, ["row", "col"], "left")

    def kernel(layers, view, wanted, rows, cols):
        d = np.full(wanted.shape, np.inf)
        for d2, i, j in reversed(_offsets(radius)):
            for there, _, _ in layers:
                d[view(there, i, j)] = np.sqrt(d2)
        i, j = np.nonzero(wanted)
        return pa.table({"row": pa.array(rows[i], pa.int32()), "col": pa.array(cols[j], pa.int32()), "distance": pa.array(d[i, j], pa.float64(), mask=np.isinf(d[i, j]))})

    return _focal(cells, data, radius, kernel, "row int, col int, distance double")


def variogram(data: DataFrame, lag: int, n_lags: int) -> DataFrame:
    """(lag, n, gamma): half the mean squared difference of pairs by distance."""
    reach = lag * n_lags

    def kernel(layers, view, wanted, rows, cols):
        n, total = np.zeros(n_lags, "i8"), np.zeros(n_lags)
        for there, z, _ in layers:
            here, own = view(there, 0, 0), view(z, 0, 0)
            for d2, i, j in _offsets(reach):
                k = int(np.sqrt(d2) // lag)
                for there2, z2, _ in layers if d2 and k < n_lags else ():
                    both = here & view(there2, i, j)
                    n[k] += both.sum()
                    total[k] += np.square(view(z2, i, j) - own, where=both, out=np.zeros(both.shape)).sum()
        return pa.table({"lag": pa.array(np.arange(n_lags), pa.int32()), "n": pa.array(n, pa.int64()), "e": pa.array(total, pa.float64())})

    sums = _focal(None, data, reach, kernel, "lag int, n long, e double").groupBy("lag").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    return sums.where("n > 0").select("lag", "n", (F.col("e") / (2 * F.col("n"))).alias("gamma"))


def vote(tables: list[tuple[DataFrame, float]]) -> DataFrame:
    """Land or water by the sign of weighted votes (row, col, vote)."""
    u = None
    for t, w in tables:
        t = t.select("row", "col", (F.col("vote") * w).alias("v"))
        u = t if u is None else u.unionByName(t)
    return u.groupBy("row", "col").agg((F.sum("v") > 0).cast("int").alias("land"))


def total_uncertainty(cells: DataFrame, a: float, b: float, c: float) -> DataFrame:
    """Cells (distance, src_uncertainty) with the interpolation's a + b d^c and the total."""
    interp = F.lit(a) + b * F.pow("distance", c)
    return cells.withColumn("interpolation_uncertainty", interp).withColumn("tvu", F.sqrt(F.col("interpolation_uncertainty") ** 2 + F.col("src_uncertainty") ** 2))


def folds(df: DataFrame, key: Column, k: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int"))
