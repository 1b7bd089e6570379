"""Resampling grids to another size, origin or spacing."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.focal import tiled
from rasterloom.sources.grids import GridSpec, cells_of


def _targets(cells: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """Cells of the target with sx, sy, their place in the source's index."""
    every = cells_of(cells.sparkSession.range(target.width * target.height), "id", target.width)
    place = lambda c, k: (F.lit(target.origin[k]) + F.col(c) * target.spacing[k] - source.origin[k]) / source.spacing[k]
    return every.withColumns({"sx": place("x", 0), "sy": place("y", 1)})


def resampled(cells: DataFrame, source: GridSpec, target: GridSpec, method: str = "linear", value: str = "value", outside: float | None = None, order: int = 3, tile: int | None = None) -> DataFrame:
    """x, y and value over the target's cells: nearest, linear (of the four cells around), bspline (of an order from 0 to 5), mean or median (of the source's cells within a target cell).

    Places outside the source get `outside`. A linear value is null if one of its four cells is, a spline's if one of those it weighs is.
    """
    if method in ("mean", "median"):
        # Each source cell falls into one target cell, so this is one aggregation.
        place = lambda c, k: F.floor((F.lit(source.origin[k]) + F.col(c) * source.spacing[k] - target.origin[k]) / target.spacing[k] + 0.5).cast("int")
        own = cells.select(place("x", 0).alias("x"), place("y", 1).alias("y"), F.col(value).cast("double").alias("v"))
        own = own.where(F.col("x").between(0, target.width - 1) & F.col("y").between(0, target.height - 1))
        found = own.groupBy("x", "y").agg((F.avg("v") if method == "mean" else F.median("v")).alias(value))
        every = cells_of(cells.sparkSession.range(target.width * target.height), "id", target.width).join(found, ["x", "y"], "left")
        return every if outside is None else every.fillna({value: outside})
    wanted = _targets(cells, source, target)
    inside = F.col("sx").between(0, source.width - 1) & F.col("sy").between(0, source.height - 1)
    given = cells.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col(value).cast("double").alias("__v"))
    if method == "nearest":
        near = wanted.withColumns({"__x": F.floor(F.col("sx") + 0.5).cast("int"), "__y": F.floor(F.col("sy") + 0.5).cast("int")})
        out = near.join(given, ["__x", "__y"], "left").select("x", "y", F.when(inside, F.col("__v")).otherwise(F.lit(outside)).alias(value))
        return out
    around = wanted.where(~inside).select("x", "y", F.lit(outside).cast("double").alias(value))
    if method == "linear":
        return _linear(cells, source, target, value, tile or 256).unionByName(around)
    if method != "bspline":
        raise ValueError(f"unknown method {method}")
    if order not in range(6):
        raise ValueError(f"splines are of order 0 to 5, not {order}")
    # Large tiles, as a spline's rim is some 50 cells wide.
    return _spline(cells, source, target, order, value, tile or 1024).unionByName(around)


def _by_tiles(cells: DataFrame, source: GridSpec, target: GridSpec, value: str, rim: int, tile: int, worked: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], mirror: bool = False) -> DataFrame:
    """The target's cells within the source: each tile of the source, with its rim, works out those that begin in it.

    worked gets the tile's padded array (NaN where no cell is) and the targets' places along x and y, counted from
    the array's corner. Beyond the grid's edges the array mirrors the grid, or is NaN.
    """
    columns, rows = math.ceil(source.width / tile), math.ceil(source.height / tile)
    tiles = cells_of(cells.sparkSession.range(columns * rows), "id", columns).select(F.col("x").alias("tx"), F.col("y").alias("ty"))

    def places(axis: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Target indices along an axis that begin among n source cells from first, and their places."""
        size, whole = (target.width, source.width) if axis == 0 else (target.height, source.height)
        at = lambda k: (k - target.origin[axis]) / target.spacing[axis]
        ends = sorted(at(source.origin[axis] + source.spacing[axis] * k) for k in (first - 1, first + n + 1))
        index = np.arange(max(0, math.floor(ends[0])), min(size, math.ceil(ends[1]) + 1))
        place = (target.origin[axis] + index * target.spacing[axis] - source.origin[axis]) / source.spacing[axis]
        own = (np.floor(place) >= first) & (np.floor(place) < first + n) & (place >= 0) & (place <= whole - 1)
        return index[own], place[own]

    def run(key: pa.Table, table: pa.Table) -> pa.Table:
        names = ["x", "y", value]
        if not key.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.float64())], names)
        x0, y0 = key.column("tx")[0].as_py() * tile, key.column("ty")[0].as_py() * tile
        w, h = min(tile, source.width - x0), min(tile, source.height - y0)
        left, top = max(0, x0 - rim), max(0, y0 - rim)
        dense = np.full((min(source.height, y0 + h + rim) - top, min(source.width, x0 + w + rim) - left), np.nan)
        x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        dense[y - top, x - left] = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        ix, iy = np.arange(x0 - rim, x0 + w + rim), np.arange(y0 - rim, y0 + h + rim)
        padded = dense[np.ix_(_mirrored(iy, source.height) - top, _mirrored(ix, source.width) - left)]
        if not mirror:
            padded[((iy < 0) | (iy >= source.height))[:, None] | ((ix < 0) | (ix >= source.width))[None]] = np.nan
        (i, sx), (j, sy) = places(0, x0, w), places(1, y0, h)
        out = worked(padded, sx - (x0 - rim), sy - (y0 - rim))
        return pa.table([pa.array(np.tile(i, len(j)), pa.int32()), pa.array(np.repeat(j, len(i)), pa.int32()), pa.array(out.ravel(), from_pandas=True)], names)

    given = tiled(cells.select("x", "y", value), source, rim, tile)
    return tiles.groupBy("tx", "ty").cogroup(given.groupBy("tx", "ty")).applyInArrow(run, f"x int, y int, {value} double")


def _mirrored(index: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond 0 .. n - 1 mirrored at the first and the last cell, as often as needed."""
    if n == 1:
        return np.zeros_like(index)
    index = index % (2 * n - 2)
    return np.minimum(index, 2 * n - 2 - index)


def _linear(cells: DataFrame, source: GridSpec, target: GridSpec, value: str, tile: int) -> DataFrame:
    """The linear values of the target's cells within the source."""

    def worked(dense: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
        left, top = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
        fx, fy = sx - left, sy - top
        out = np.zeros((len(sy), len(sx)))
        for dx, wx in ((0, 1 - fx), (1, fx)):
            for dy, wy in ((0, 1 - fy), (1, fy)):
                weight = wy[:, None] * wx[None]
                # A corner that weighs nothing may be missing.
                out += np.where(weight > 0, weight * dense[np.ix_(top + dy, left + dx)], 0)
        return out

    return _by_tiles(cells, source, target, value, 1, tile, worked)


#: What the rim of a tile may leave of the influence of values beyond it, as a share of them.
SPLINE_ERROR = 1e-14


def spline(order: int, t: np.ndarray) -> np.ndarray:
    """The centred B-spline of an order at t, by divided differences of truncated powers; order 0 is 1 on [-1/2, 1/2)."""
    out = np.zeros_like(t, dtype=float)
    for j in range(order + 2):
        reach = t + (order + 1) / 2 - j
        out += (-1) ** j * math.comb(order + 1, j) * np.where(reach >= 0, np.maximum(reach, 0) ** order, 0)
    return out / math.factorial(order)


def spline_poles(order: int) -> list[float]:
    """Poles of the filter that turns values into B-spline coefficients: the roots within the unit circle of the spline's values at whole numbers."""
    half = order // 2
    roots = np.roots(spline(order, np.arange(-half, half + 1, dtype=float))) if order > 1 else []
    return sorted((float(r.real) for r in roots if abs(r) < 1), reverse=True)


def spline_rim(order: int) -> int:
    """Cells that a tile needs around it: where the slowest pole's powers, once for each pole, are under SPLINE_ERROR, and the spline's own width."""
    poles = spline_poles(order)
    return order // 2 + 2 + (len(poles) * 4 + math.ceil(math.log(SPLINE_ERROR) / math.log(max(map(abs, poles)))) if poles else 0)


def _coefficients(values: np.ndarray, poles: list[float]) -> np.ndarray:
    """B-spline coefficients along the first axis: for each pole a recursion forwards and one backwards. What they start from is forgotten as the pole's powers."""
    out = values.copy()
    for z in poles:
        out *= (1 - z) * (1 - 1 / z)
        out[0] /= 1 - z
        for k in range(1, len(out)):
            out[k] += z * out[k - 1]
        out[-1] *= z / (z - 1)
        for k in range(len(out) - 2, -1, -1):
            out[k] = z * (out[k + 1] - out[k])
    return out


def _spline(cells: DataFrame, source: GridSpec, target: GridSpec, order: int, value: str, tile: int) -> DataFrame:
    """Values at the target's cells of the B-spline through the source's cells; the grid is mirrored at its edges.

    The recursions run over a tile and its rim, so tiles of any size agree to SPLINE_ERROR of the values. Missing
    cells count as 0 in the recursions; a value is null if one of the (order + 1) squared cells that it weighs is missing.
    """
    poles = spline_poles(order)

    def weights(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the order + 1 cells that its spline weighs, and their weights."""
        index = (np.floor(place - (order + 1) / 2).astype(np.int64) + 1)[:, None] + np.arange(order + 1)
        return index, spline(order, place[:, None] - index)

    def worked(dense: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
        missing = np.isnan(dense)
        c = np.where(missing, 0, dense)
        c = _coefficients(_coefficients(c, poles).T.copy(), poles).T
        (ix, wx), (iy, wy) = weights(sx), weights(sy)
        rows = sum(c[:, ix[:, k]] * wx[:, k] for k in range(order + 1))
        out = sum(rows[iy[:, k]] * wy[:, k, None] for k in range(order + 1))
        if missing.any():
            gone = np.zeros(out.shape, bool)
            for a in range(order + 1):
                for b in range(order + 1):
                    gone |= missing[np.ix_(iy[:, a], ix[:, b])] & (wy[:, a, None] * wx[None, :, b] != 0)
            out[gone] = np.nan
        return out

    return _by_tiles(cells, source, target, value, spline_rim(order), tile, worked, mirror=True)


def shrunk(spec: GridSpec, factor: int) -> GridSpec:
    """The grid of cells `factor` times as large, with centres amid the ones they cover."""
    spacing = tuple(s * factor for s in spec.spacing)
    origin = tuple(o + s * (factor - 1) / 2 for o, s in zip(spec.origin, spec.spacing, strict=True))
    return GridSpec(math.ceil(spec.width / factor), math.ceil(spec.height / factor), origin, spacing)
