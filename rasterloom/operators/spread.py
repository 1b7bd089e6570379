"""What spreads over a grid: distances, cost distances, flow.

Euclidean distance is exact and takes two passes, over columns by strips and over rows. Cost distance and flow work
within tiles and pass on what crosses tile borders until nothing new crosses. A task has a group of tiles, and
the rounds' number is that of the groups' borders a path crosses, not of its cells. A round works on the tiles
at which something new has arrived, and its result is stored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.sources.grids import GridSpec
from rasterloom.sources.stored import emptied, stored

#: Neighbours as (dx, dy), clockwise from the north-west.
AROUND = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]
INFINITY = float("inf")


#: Rows of a strip: a column is searched strip by strip, so that no task holds a whole one.
STRIP = 4096
#: Cells that the pass over rows takes at a time, in whole rows.
ROWS_CELLS = 1 << 16


def _to_nearest(cells: DataFrame, source: Column) -> DataFrame:
    """x, y and dy: rows to the nearest source cell of the column."""
    at = cells.select("x", "y", F.floor(F.col("y") / STRIP).alias("strip"), F.when(source, F.col("y")).alias("at"))
    ends = at.groupBy("x", "strip").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # Windows reach back only, as Spark adds up one that reaches forward anew for each row.
    up, down = W.partitionBy("x").orderBy("strip"), W.partitionBy("x").orderBy(F.desc("strip"))
    beyond = ends.select("x", "strip", F.last("last", True).over(up.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.last("first", True).over(down.rowsBetween(W.unboundedPreceding, -1)).alias("after"))
    own = W.partitionBy("x", "strip")
    last = F.last("at", True).over(own.orderBy("y").rowsBetween(W.unboundedPreceding, 0))
    following = F.last("at", True).over(own.orderBy(F.desc("y")).rowsBetween(W.unboundedPreceding, 0))
    # F.least passes over nulls.
    dy = F.least(F.col("y") - F.coalesce(last, F.col("before")), F.coalesce(following, F.col("after")) - F.col("y"))
    return at.join(beyond, ["x", "strip"]).select("x", "y", dy.alias("dy"))


def euclidean_distance(cells: DataFrame, spec: GridSpec, categories: list[float], maximum: float | None = None, use_spacing: bool = True, value: str = "value") -> DataFrame:
    """x, y and distance to the nearest cell of one of the categories; null without any, or beyond the maximum."""
    sx, sy = spec.spacing if use_spacing else (1.0, 1.0)
    near = _to_nearest(cells, F.col(value).isin(categories))

    def row(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        # The lower envelope of the parabolas that stand over the columns' own distances.
        hull, cuts = [], []
        for q in np.flatnonzero(~np.isnan(g)).tolist():
            while hull:
                v = hull[-1]
                s = ((g[q] ** 2 + x[q] ** 2) - (g[v] ** 2 + x[v] ** 2)) / (2 * x[q] - 2 * x[v])
                if s > cuts[-1]:
                    break
                hull.pop()
                cuts.pop()
            cuts.append(-INFINITY if not hull else s)
            hull.append(q)
        if not hull:
            return np.full(len(x), np.nan)
        best = np.array(hull)[np.searchsorted(np.array(cuts), x, "right") - 1]
        return np.sqrt((x - x[best]) ** 2 + g[best] ** 2)

    def rows(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
        g = table.column("dy").cast(pa.float64()).to_numpy()[order] * sy
        cuts = [0, *(np.flatnonzero(np.diff(y)) + 1).tolist(), len(y)]
        out = [row(x[lo:hi] * sx, g[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        return pa.table([x, y, pa.array(np.concatenate(out), from_pandas=True)], ["x", "y", "distance"])

    few = max(1, ROWS_CELLS // max(1, spec.width))
    out = near.groupBy(F.floor(F.col("y") / few).alias("rows")).applyInArrow(rows, "x int, y int, distance double")
    return out if maximum is None else out.withColumn("distance", F.when(F.col("distance") <= maximum, F.col("distance")))


def buffered(distances: DataFrame, indicator: int = 1) -> DataFrame:
    """x, y and zone: the indicator within the buffer, 0 outside."""
    return distances.select("x", "y", F.when(F.col("distance").isNotNull(), indicator).otherwise(0).alias("zone"))


#: Rounds whose results are kept apart before they are stored as one table.
ROUNDS_APART = 16
#: Cells of the tiles that one task works on till nothing new crosses between them.
GROUP_CELLS = 1 << 20
#: What a tile knows of a place of its array: nothing, a cell with a null value, a cell with a value.
ABSENT, NULL, VALUED = 0, 1, 2
_TILES = "tx int, ty int, state binary, bands binary"
_DONE = "fx int, fy int, tx int, ty int, places binary, numbers binary, mark binary, leaving boolean, fresh boolean"


def _latest(rounds: list[DataFrame]) -> DataFrame:
    """Of tables with columns fx, fy (a tile) and round, each tile's rows of its last round."""
    rows = reduce(DataFrame.union, rounds)
    last = rows.groupBy("fx", "fy").agg(F.max("round").alias("round"))
    # A join puts its keys first; unions go by place.
    return rows.join(last, ["fx", "fy", "round"]).select(*rows.columns) if len(rounds) > 1 else rows


def _tiles(cells: DataFrame, bands: list[str], tile: int) -> DataFrame:
    """A row a tile: of its cells, and of those in a rim of one cell round it, whether they are there and have a first band, and the bands, as arrays."""
    side = tile + 2

    def pack(table: pa.Table) -> pa.Table:
        tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
        x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        at = (y - ty * tile + 1) * side + x - tx * tile + 1
        if not ((x // tile == tx) & (y // tile == ty)).any():
            return _TILES_EMPTY
        state, values = np.zeros(side * side, np.uint8), np.full((len(bands), side * side), np.nan)
        state[at] = np.where(np.asarray(table.column(bands[0]).is_valid()), VALUED, NULL)
        for k, b in enumerate(bands):
            values[k, at] = table.column(b).to_numpy()
        return pa.table([pa.array([tx], pa.int32()), pa.array([ty], pa.int32()), pa.array([state.tobytes()]), pa.array([values.tobytes()])], _TILES_EMPTY.schema.names)

    reach = lambda c: F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(c) + d) / tile).cast("int"))))
    spread_out = cells.select("x", "y", *bands).withColumn("tx", reach("x")).withColumn("ty", reach("y"))
    return spread_out.groupBy("tx", "ty").applyInArrow(pack, _TILES)


_TILES_EMPTY = pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())], ["tx", "ty", "state", "bands"])


def _rounds(cells: DataFrame, spec: GridSpec, tile: int, bands: list[str], work, better: np.ufunc, nothing: float) -> DataFrame:
    """x, y and value: runs work over tiles, then again over those whose arrivals have changed, until none has.

    A tile travels as arrays with a rim of one cell. work gets a Tile and what has arrived at each of its places
    (`nothing` where nothing has), and returns values of places, NaN for none: those of the rim are what leaves the
    tile. `better` puts together the arrivals of one cell. A task has a group of neighbouring tiles and goes on until
    nothing new crosses between them, so a round takes what has changed across a whole group; a narrow grid's groups are long.
    """
    side = tile + 2
    most = max(1, GROUP_CELLS // tile**2)
    across = max(1, min(math.ceil(spec.width / tile), math.isqrt(most)))
    down = most // across
    placed = stored(_tiles(cells, bands, tile))
    kinds = [*[pa.int32()] * 4, *[pa.binary()] * 3, *[pa.bool_()] * 2]
    names = [f.split()[0] for f in _DONE.split(", ")]
    none = (None, None, None)

    def group(tx: str, ty: str) -> list[Column]:
        return [F.floor(F.col(tx) / across).alias("gx"), F.floor(F.col(ty) / down).alias("gy")]

    def first(new: tuple, old: tuple) -> float:
        """The least number that a message changes, where lower ones come first: tiles run in that order, so that few run again."""
        if better is not np.minimum:
            return 0.0
        numbers = np.frombuffer(new[1])
        return float((numbers[numbers != np.frombuffer(old[1])] if new[0] == old[0] else numbers).min(initial=INFINITY))

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        tiles = {(row["tx"], row["ty"]): Tile.of(row, bands, tile) for row in table.to_pylist()}
        got, sent, due = {at: {} for at in tiles}, {at: {} for at in tiles}, {}
        for fx, fy, tx, ty, *message in zip(*(given.column(c).to_pylist() for c in names[:7]), strict=True):
            if message[0] is None:
                due |= {(tx, ty): 0} if (tx, ty) in tiles else {}
                continue
            if (tx, ty) in tiles:
                got[tx, ty][fx, fy] = message
            if (fx, fy) in tiles:
                sent[fx, fy][tx, ty] = message
        before, values = {at: dict(to) for at, to in sent.items()}, {}
        due = dict.fromkeys(sorted(due), -INFINITY)
        while due:
            at = min(due, key=due.get)
            del due[at]
            t, arrivals = tiles[at], np.full(side * side, nothing)
            for _, (places, numbers, _) in sorted(got[at].items()):
                better.at(arrivals, np.frombuffer(places, np.int32), np.frombuffer(numbers))
            out = work(t, arrivals)
            own = np.flatnonzero(t.own & (t.state != ABSENT)).astype(np.int32)
            values[at] = own.tobytes(), out[own].tobytes()
            gone = np.flatnonzero(~t.own & ~np.isnan(out))
            y, x = np.divmod(gone, side)
            dx, dy = (np.where(v == 0, -1, np.where(v == side - 1, 1, 0)) for v in (x, y))
            new = {}
            for i, j in AROUND:
                k = (dx == i) & (dy == j)
                if k.any():
                    there = ((y[k] - j * tile) * side + x[k] - i * tile).astype(np.int32).tobytes()
                    new[t.tx + i, t.ty + j] = there, out[gone[k]].tobytes(), there + np.round(out[gone[k]], 9).tobytes()
            for to in tiles.keys() & (new.keys() | sent[at].keys()):
                if new.get(to, none)[2] != sent[at].get(to, none)[2]:
                    due[to] = min(due.get(to, INFINITY), first(new.get(to, none), sent[at].get(to, none)))
                got[to].pop(at, None)
                if to in new:
                    got[to][at] = new[to]
            # What a tile that has run again sends takes the place of all that it sent before.
            sent[at] = new
        rows = [(*at, *at, *value, None, False, False) for at, value in values.items()]
        for at in tiles:
            for to in sent[at].keys() | before[at].keys():
                message = sent[at].get(to, none)
                rows.append((*at, *to, *message, True, to not in tiles and message[2] != before[at].get(to, none)[2]))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    spark = cells.sparkSession
    leaving = stored(spark.createDataFrame([], _DONE))
    changed, values, number = placed.select("tx", "ty"), [], 0
    while True:
        groups = changed.select(*group("tx", "ty")).distinct()
        # Each group gets what its tiles have sent and what they were sent, and the names of those to run.
        both = leaving.select("*", F.explode(F.array_distinct(F.array(F.struct(*group("fx", "fy")), F.struct(*group("tx", "ty"))))).alias("g")).select(*names[:7], "g.*")
        marked = changed.select(F.col("tx").alias("fx"), F.col("ty").alias("fy"), "tx", "ty", *(F.lit(None).cast("binary").alias(c) for c in names[4:7]), *group("tx", "ty"))
        given = both.join(groups, ["gx", "gy"], "left_semi").unionByName(marked)
        todo = placed.select("*", *group("tx", "ty")).join(groups, ["gx", "gy"], "left_semi")
        done = stored(todo.groupBy("gx", "gy").cogroup(given.groupBy("gx", "gy")).applyInArrow(run, _DONE).withColumn("round", F.lit(number)))
        values.append(done.where("not leaving"))
        if len(values) >= ROUNDS_APART:
            values = [stored(_latest(values))]
        others = leaving.select("*", *group("fx", "fy")).join(groups, ["gx", "gy"], "left_anti").select(*names)
        changed = stored(done.where("fresh").select("tx", "ty").distinct())
        if changed.isEmpty():
            break
        old, leaving, number = leaving, stored(done.where("leaving and places is not null").select(*names).union(others)), number + 1
        emptied(old)

    def unpack(batches):
        for batch in batches:
            for tx, ty, places, numbers in zip(*(batch.column(c).to_pylist() for c in ("fx", "fy", "places", "numbers")), strict=True):
                y, x = np.divmod(np.frombuffer(places, np.int32), side)
                yield pa.RecordBatch.from_arrays([pa.array((x - 1 + tx * tile).astype(np.int32)), pa.array((y - 1 + ty * tile).astype(np.int32)), pa.array(np.frombuffer(numbers), from_pandas=True)], ["x", "y", "value"])

    return _latest(values).select("fx", "fy", "places", "numbers").mapInArrow(unpack, "x int, y int, value double")


@dataclass
class Tile:
    """A tile's places as flat arrays of (tile + 2) squared: the tile's own ones and a rim of one cell."""

    tx: int
    ty: int
    side: int
    state: np.ndarray
    bands: dict[str, np.ndarray]
    own: np.ndarray
    last: np.ndarray | None = None  # what its work keeps for when it runs again in the same task

    @classmethod
    def of(cls, row: dict, bands: list[str], tile: int) -> Tile:
        side = tile + 2
        own = np.zeros((side, side), bool)
        own[1:-1, 1:-1] = True
        values = np.frombuffer(row["bands"]).reshape(len(bands), -1)
        return cls(row["tx"], row["ty"], side, np.frombuffer(row["state"], np.uint8), dict(zip(bands, values, strict=True)), own.ravel())

    @property
    def steps(self) -> np.ndarray:
        """From a place to its neighbours, in the order of AROUND."""
        return np.array([dy * self.side + dx for dx, dy in AROUND])

    def within(self, spec: GridSpec) -> np.ndarray:
        """The tile's own cells with a value that don't lie on the grid's edge."""
        at = np.flatnonzero(self.own & (self.state == VALUED))
        y, x = np.divmod(at, self.side)
        x, y = x - 1 + self.tx * (self.side - 2), y - 1 + self.ty * (self.side - 2)
        return at[(x > 0) & (x < spec.width - 1) & (y > 0) & (y < spec.height - 1)]

    def in_order(self, start: np.ndarray, goes: np.ndarray, pass_on) -> None:
        """Calls pass_on with sets of rows, each after all rows that lead to its cells. start: a cell a row; goes: for each, whether a way leads to each neighbour. No way leads back."""
        row = np.full(len(self.own), -1)
        row[start] = np.arange(len(start))
        to = np.where(goes, start[:, None] + self.steps, -1)
        waits = np.bincount(to[goes], minlength=len(self.own))
        now = np.flatnonzero(waits[start] == 0)
        while len(now):
            reached = to[now][goes[now]]
            pass_on(now)
            np.subtract.at(waits, reached, 1)
            now = row[np.unique(reached[waits[reached] == 0])]
            now = now[now >= 0]


def cost_distance(cells: DataFrame, spec: GridSpec, source: str, cost: str, maximum: float | None = None, tile: int = 256) -> DataFrame:
    """x, y and distance: the least sum of costs from a cell whose source flag is true. A step's cost is the entered cell's, times the diagonal's length where it is diagonal; null costs can't be entered."""
    diagonal = math.hypot(*spec.spacing)
    length = np.array([diagonal if dx and dy else 1.0 for dx, dy in AROUND])

    def work(t: Tile, arrivals: np.ndarray) -> np.ndarray:
        # Null costs can't be entered. What arrives includes the step into its cell.
        price = np.where(t.state == VALUED, t.bands["cost"], np.nan)
        if t.last is None:
            t.last = np.full(len(price), INFINITY)
            arrivals = np.where(t.own & (t.bands["source"] == 1), 0.0, arrivals)
            enter = t.own & ((t.state == VALUED) | (arrivals == 0))
        else:
            # What arrives only gets less, so a tile goes on from its last values.
            enter = t.own & (t.state == VALUED)
        best = t.last
        now = np.flatnonzero(enter & (arrivals < best))
        best[now] = arrivals[now]
        while len(now):
            to = (now[:, None] + t.steps).ravel()
            new = (best[now][:, None] + price[now[:, None] + t.steps] * length).ravel()
            nearer = new < best[to]
            to, new = to[nearer], new[nearer]
            np.minimum.at(best, to, new)
            now = np.unique(to)
            # Nothing comes back from the rim but by its own tile.
            now = now[t.own[now]]
        return np.where(best < INFINITY, best, np.nan)

    base = cells.select("x", "y", F.col(cost).cast("double").alias("cost"), F.coalesce(F.col(source), F.lit(False)).cast("double").alias("source"))
    out = _rounds(base, spec, tile, ["cost", "source"], work, np.minimum, INFINITY).withColumnRenamed("value", "distance")
    return out if maximum is None else out.withColumn("distance", F.when(F.col("distance") <= maximum, F.col("distance")))


def flow_shares(z: float, around: list[float | None], spec: GridSpec, algorithm: str, exponent: float) -> list[float]:
    """The share of a cell's flow that each of its eight neighbours gets."""
    h = np.array([[np.nan if v is None else v for v in around]], np.float64)
    return _shares(np.array([z], np.float64), h, spec, algorithm, exponent)[0].tolist()


def _shares(z: np.ndarray, around: np.ndarray, spec: GridSpec, algorithm: str, exponent: float) -> np.ndarray:
    """The same of many cells, a row each; NaN for no data."""
    sx, sy = spec.spacing
    if algorithm == "dinf":
        return _facet_shares(z, around, spec)
    down = z[:, None] - around
    if algorithm == "mfd":
        length = np.array([sy * math.sqrt(2) if dx and dy else (sx if dx else sy) for dx, dy in AROUND])
        out = down / length * np.array([0.354 if dx and dy else 0.5 for dx, dy in AROUND]) * length
    else:
        length = np.array([math.hypot(sx, sy) if dx and dy else (sx if dx else sy) for dx, dy in AROUND])
        out = (np.where(down > 0, down, 0.0) / length) ** exponent
    out = np.where(down > 0, out, 0.0)
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=out, where=total != 0)


def _facet_shares(z: np.ndarray, around: np.ndarray, spec: GridSpec) -> np.ndarray:
    """The steepest direction over eight triangular facets; its flow is parted between the two neighbours that it lies between, by angle. A cell beside no data passes nothing on."""
    n = np.arange(len(z))
    best, straight_to, corner_to, part = np.zeros(len(z)), np.zeros(len(z), np.int64), np.zeros(len(z), np.int64), np.zeros(len(z))
    for k in (1, 3, 5, 7):
        straight = spec.spacing[0] if AROUND[k][0] else spec.spacing[1]
        across = spec.spacing[1] if AROUND[k][0] else spec.spacing[0]
        widest, length = math.atan2(across, straight), math.hypot(straight, across)
        for corner in ((k - 1) % 8, (k + 1) % 8):
            s1, s2 = (z - around[:, k]) / straight, (around[:, k] - around[:, corner]) / across
            angle = np.arctan2(s2, s1)
            slope = np.where(angle < 0, s1, np.where(angle > widest, (z - around[:, corner]) / length, np.hypot(s1, s2)))
            steeper = slope > best
            best[steeper], straight_to[steeper], corner_to[steeper] = slope[steeper], k, corner
            part[steeper] = np.clip(angle[steeper], 0.0, widest) / widest
    shares = np.zeros((len(z), 8))
    found = (best > 0) & ~np.isnan(around).any(axis=1)
    shares[n[found], straight_to[found]], shares[n[found], corner_to[found]] = 1 - part[found], part[found]
    return shares


def _weighed(cells: DataFrame, value: str, weight: str | None) -> DataFrame:
    return cells.select("x", "y", F.col(value).cast("double").alias("z"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))


def flow_accumulation(cells: DataFrame, spec: GridSpec, algorithm: str = "mfd", exponent: float = 1.0, value: str = "value", weight: str | None = None, tile: int = 256) -> DataFrame:
    """x, y and accumulation: 1 for the cell itself and what its higher neighbours pass on. Cells on the grid's edge receive but don't pass on; null cells do neither."""

    def work(t: Tile, arrivals: np.ndarray) -> np.ndarray:
        z, w = t.bands["z"], t.bands["w"]
        start = t.within(spec)
        beside = start[:, None] + t.steps
        share = _shares(z[start], z[beside], spec, algorithm, exponent)
        goes = (share != 0) & (z[beside] < z[start][:, None])
        part = share * w[beside]
        # A place of the rim holds what leaves for it.
        flow = np.where(t.own, np.where(t.state == VALUED, 1.0 + arrivals, np.nan), 0.0)

        def pass_on(now: np.ndarray) -> None:
            np.add.at(flow, beside[now][goes[now]], (part[now] * flow[start[now]][:, None])[goes[now]])

        t.in_order(start, goes, pass_on)
        flow[~t.own & (flow == 0)] = np.nan
        return flow

    return _rounds(_weighed(cells, value, weight), spec, tile, ["z", "w"], work, np.add, 0.0).withColumnRenamed("value", "accumulation")


def flow_length(cells: DataFrame, spec: GridSpec, upstream: bool = False, value: str = "value", weight: str | None = None, tile: int = 256) -> DataFrame:
    """x, y and length: of the longest way down to the cell over ever lower neighbours, or with upstream up to it over ever higher ones; 0 where none begins.

    A step counts its length times the entered cell's weight. Cells on the grid's edge are entered but not left; null cells are neither.
    """
    sx, sy = spec.spacing
    lengths = np.array([math.hypot(sx, sy) if dx and dy else (sx if dx else sy) for dx, dy in AROUND])

    def work(t: Tile, arrivals: np.ndarray) -> np.ndarray:
        z, w = -t.bands["z"] if upstream else t.bands["z"], t.bands["w"]
        start = t.within(spec)
        beside = start[:, None] + t.steps
        goes = z[beside] < z[start][:, None]
        step = lengths * w[beside]
        length = np.where(t.own, np.where(t.state == VALUED, np.maximum(arrivals, 0.0), np.nan), 0.0)

        def pass_on(now: np.ndarray) -> None:
            np.maximum.at(length, beside[now][goes[now]], (step[now] + length[start[now]][:, None])[goes[now]])

        t.in_order(start, goes, pass_on)
        length[~t.own & (length == 0)] = np.nan
        return length

    return _rounds(_weighed(cells, value, weight), spec, tile, ["z", "w"], work, np.maximum, 0.0).withColumnRenamed("value", "length")
