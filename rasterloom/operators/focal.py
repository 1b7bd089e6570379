"""Neighbourhood operators over tiles with a rim.

Each cell goes to its tile and, near a border, to the tiles whose rim it belongs to: one shuffle of little
more than the grid, whatever the radius. In a tile, windows are shifted views of one dense array.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.expressions import ExpressionError, compiled
from rasterloom.sources.grids import GridSpec

TILE = 256


def tiled(cells: DataFrame, spec: GridSpec, radius: int, tile: int = TILE) -> DataFrame:
    """Cells with tx, ty of every tile in whose rim of `radius` they lie."""

    def tiles(c: str, size: int) -> Column:
        last = (size - 1) // tile
        lo = F.greatest(F.lit(0), F.floor((F.col(c) - radius) / tile)).cast("int")
        return F.sequence(lo, F.least(F.lit(last), F.floor((F.col(c) + radius) / tile)).cast("int"))

    inside = cells.where(F.col("x").between(0, spec.width - 1) & F.col("y").between(0, spec.height - 1))
    return inside.withColumn("tx", F.explode(tiles("x", spec.width))).withColumn("ty", F.explode(tiles("y", spec.height)))


def over_tiles(cells: DataFrame, spec: GridSpec, radius: int, bands: list[str], work: Callable[..., dict[str, np.ndarray]], schema: str, edge: str = "repeat", tile: int = TILE) -> DataFrame:
    """Applies work to the padded arrays (rows, columns) of the named bands in each tile.

    Outside the grid values repeat the nearest edge cell's, or with edge="none" are NaN as missing and null
    cells are. work returns arrays of the tile's own size; NaN becomes null. Only cells that exist are
    returned. schema names x, y and work's columns.
    """
    width, height = spec.width, spec.height

    def run(table: pa.Table) -> pa.Table:
        x0, y0 = table.column("tx")[0].as_py() * tile, table.column("ty")[0].as_py() * tile
        w, h = min(tile, width - x0), min(tile, height - y0)
        x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        left, top = max(0, x0 - radius), max(0, y0 - radius)
        right, bottom = min(width, x0 + w + radius), min(height, y0 + h + radius)
        ix, iy = np.clip(np.arange(x0 - radius, x0 + w + radius), 0, width - 1) - left, np.clip(np.arange(y0 - radius, y0 + h + radius), 0, height - 1) - top
        outside = np.zeros((h + 2 * radius, w + 2 * radius), bool)
        if edge != "repeat":
            yy, xx = np.arange(y0 - radius, y0 + h + radius), np.arange(x0 - radius, x0 + w + radius)
            outside = ((yy < 0) | (yy >= height))[:, None] | ((xx < 0) | (xx >= width))[None]
        padded = []
        for b in bands:
            dense = np.full((bottom - top, right - left), np.nan)
            dense[y - top, x - left] = table.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False)
            p = dense[np.ix_(iy, ix)]
            p[outside] = np.nan
            padded.append(p)
        own = (x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + h)
        x, y = x[own], y[own]
        out = work(*padded)
        columns = [pa.array(x, pa.int32()), pa.array(y, pa.int32())]
        for values in out.values():
            v = values[y - y0, x - x0]
            if v.ndim > 1:
                each = v.shape[1]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * each, pa.int32()), pa.array(np.ascontiguousarray(v, np.float64).ravel())))
            else:
                columns.append(pa.array(v, from_pandas=True))
        return pa.table(columns, ["x", "y", *out])

    return tiled(cells, spec, radius, tile).select("tx", "ty", "x", "y", *bands).groupBy("tx", "ty").applyInArrow(run, schema)


def neighbours_equal(cells: DataFrame, spec: GridSpec, radius: int, value: float, band: str = "value") -> DataFrame:
    """x, y and count of the cells of the square window, centre included, that equal the value; edges repeat."""

    def work(p: np.ndarray) -> dict[str, np.ndarray]:
        hit = (p == value).astype(np.int64)
        side = 2 * radius + 1
        sums = np.zeros((hit.shape[0] + 1, hit.shape[1] + 1), np.int64)
        sums[1:, 1:] = hit.cumsum(0).cumsum(1)
        return {"count": sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]}

    return over_tiles(cells, spec, radius, [band], work, "x int, y int, count long")


def distance_classes(radius: int) -> list[float]:
    """Ascending distances of the cells of a circular window, the centre left out."""
    return sorted({math.sqrt(x * x + y * y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if 0 < x * x + y * y <= radius * radius})


def distance_weights(cells: DataFrame, spec: GridSpec, radius: int, values: list[float], weights: list[list[float]], band: str = "value") -> DataFrame:
    """x, y and weight: over a circular window without its centre, the sum of weights[value][distance class]. Other values and cells outside the grid weigh 0."""
    classes = distance_classes(radius)
    if any(len(row) != len(classes) for row in weights) or len(weights) != len(values):
        raise ValueError(f"weights need {len(values)} rows of {len(classes)} distances")

    def work(p: np.ndarray) -> dict[str, np.ndarray]:
        h, w = p.shape[0] - 2 * radius, p.shape[1] - 2 * radius
        total = np.zeros((h, w))
        hits = [p == v for v in values]
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                if 0 < dx * dx + dy * dy <= radius * radius:
                    k = classes.index(math.sqrt(dx * dx + dy * dy))
                    for hit, row in zip(hits, weights, strict=True):
                        total += hit[radius + dy : radius + dy + h, radius + dx : radius + dx + w] * row[k]
        return {"weight": total}

    return over_tiles(cells, spec, radius, [band], work, "x int, y int, weight double", edge="none")


def gradients(p: np.ndarray, spec: GridSpec, horn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Slopes along x and y of the inner cells, by Horn's or by Zevenbergen and Thorne's differences."""
    n = [p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    dx, dy = spec.spacing
    if horn:
        return ((n[2] + 2 * n[5] + n[8]) - (n[0] + 2 * n[3] + n[6])) / (8 * dx), ((n[8] + 2 * n[7] + n[6]) - (n[2] + 2 * n[1] + n[0])) / (8 * dy)
    return (n[5] - n[3]) / (2 * dx), (n[1] - n[7]) / (2 * dy)


def terrain(cells: DataFrame, spec: GridSpec, attribute: str = "slope", unit: str = "degree", algorithm: str = "horn", band: str = "value", flow: str | None = None) -> DataFrame:
    """x, y and a terrain attribute: slope (degree, percent, dimless), aspect (degrees), wetness, transport or ls; the last three need flow accumulation."""
    horn = algorithm == "horn"
    area = spec.spacing[0] * spec.spacing[1]
    diameter = 2 * math.sqrt(area / math.pi)

    def aspect(zx, zy):
        out = np.degrees(np.arctan2(zy, zx) - math.pi / 2 if horn else np.arctan2(zx, zy) - math.pi)
        return np.where(out < 0, out + 360, out)

    def work(p: np.ndarray, *rest: np.ndarray) -> dict[str, np.ndarray]:
        zx, zy = gradients(p, spec, horn)
        s = np.hypot(zx, zy)
        with np.errstate(all="ignore"):
            if attribute == "slope":
                return {"slope": {"degree": np.degrees(np.arctan(s)), "percent": 100 * s, "dimless": s}[unit]}
            if attribute == "aspect":
                return {"aspect": aspect(zx, zy)}
            flow_in = rest[0][1:-1, 1:-1] * area
            sine = np.sin(np.arctan(s))
            if attribute == "wetness":
                return {"wetness": np.where(s == 0, np.nan, np.log(flow_in / diameter / s))}
            if attribute == "transport":
                return {"transport": (flow_in / 22.13) ** 0.6 * (sine / 0.0896) ** 1.3}
            beta = (sine / 0.0896) / (3 * sine**0.8 + 0.56)
            m = beta / (1 + beta)
            turn = np.radians(aspect(zx, zy))
            across = np.abs(np.sin(turn)) + np.abs(np.cos(turn))
            length = np.where(s == 0, 1, (flow_in ** (m + 1) - (flow_in - area) ** (m + 1)) / (diameter ** (m + 2) * across**m * 22.13**m))
            return {"ls": length * np.where(100 * s < 9, 10.8 * sine + 0.03, 16.8 * sine - 0.5)}

    bands = [band] if flow is None else [band, flow]
    return over_tiles(cells, spec, 1, bands, work, f"x int, y int, {attribute} double")


def windowed(cells: DataFrame, spec: GridSpec, radius: int | tuple[int, int], bands: list[str], circular: bool = False) -> DataFrame:
    """x, y and for each band win_<band>, the values of the window in row-major order; edges repeat. For scripts that need whole windows.

    radius may be one for each axis. A circular window holds only the cells within the ellipse of those radii.
    """
    rx, ry = (radius, radius) if isinstance(radius, int) else radius
    most = max(rx, ry)
    side = 2 * most + 1
    inside = np.zeros((side, side), bool)
    for dy in range(-ry, ry + 1):
        for dx in range(-rx, rx + 1):
            inside[most + dy, most + dx] = not circular or (dx * ry) ** 2 + (dy * rx) ** 2 <= (rx * ry) ** 2
    places = np.flatnonzero(inside)

    def work(*padded: np.ndarray) -> dict[str, np.ndarray]:
        views = [np.lib.stride_tricks.sliding_window_view(p, (side, side)) for p in padded]
        return {f"win_{b}": v.reshape(*v.shape[:2], side * side)[:, :, places] for b, v in zip(bands, views, strict=True)}

    return over_tiles(cells, spec, most, bands, work, "x int, y int, " + ", ".join(f"win_{b} array<double>" for b in bands))


#: A statement of a kernel script: the name, the sign before "=", the expression; and the head of a loop: the index and its end.
STATEMENT = re.compile(r"\s*([A-Za-z_]\w*)\s*([-+*/]?)=(?!=)\s*(.+)$", re.S)
LOOP = re.compile(r"\s*for\s+([A-Za-z_]\w*)\s*<\s*([^:]+?)\s*:\s*(.+)$", re.S)


def kernel_functions(radius: int, tables: dict[str, list[list[float]]] | None = None) -> dict[str, Callable[..., Column]]:
    """kwinVal(band, i), neigDist(i), kwinSum, kwinMean, kwinMin, kwinMax of a band, and tabVal('table', column, row)."""
    side = 2 * radius + 1
    distance = F.array(*(F.lit(math.hypot(i % side - radius, i // side - radius)) for i in range(side * side)))
    held = {n: F.array(*(F.array(*map(F.lit, row)) for row in rows)) for n, rows in (tables or {}).items()}
    window = lambda b: F.filter(b, lambda v: ~F.isnan(v))
    total = lambda b: F.aggregate(window(b), F.lit(0.0), lambda a, v: a + v)

    def table(name: Column, column: Column, row: Column) -> Column:
        out = F.lit(None).cast("double")
        for n, rows in held.items():
            out = F.when(name == n, F.get(F.get(rows, row.cast("int")), column.cast("int"))).otherwise(out)
        return out

    return {
        "kwinVal": lambda b, i: F.get(b, i.cast("int")),
        "neigDist": lambda i: F.get(distance, i.cast("int")),
        "kwinSum": total,
        "kwinMean": lambda b: F.try_divide(total(b), F.size(window(b)).cast("double")),
        "kwinMin": lambda b: F.array_min(window(b)),
        "kwinMax": lambda b: F.array_max(window(b)),
        "tabVal": table,
    }


def _statements(text: str) -> list[str]:
    """Statements of a text, divided by semicolons outside braces."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            raise ExpressionError(f"a brace too many: {text!r}")
        if c == ";" and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    if depth:
        raise ExpressionError(f"a brace is open: {text!r}")
    return [s.strip() for s in [*out, part] if s.strip()]


def _body(text: str) -> list[str]:
    """What a loop runs: one statement, or those in braces."""
    text = text.strip()
    return _statements(text[1:-1]) if text.startswith("{") and text.endswith("}") else [text]


def _assigned(statements: list[str]) -> list[str]:
    """Names that statements assign, those of loops within too, in order."""
    out: list[str] = []
    for s in statements:
        if loop := LOOP.match(s):
            out += _assigned(_body(loop.group(3)))
        elif m := STATEMENT.match(s):
            out.append(m.group(1))
        else:
            raise ExpressionError(f"no statement: {s!r}")
    return list(dict.fromkeys(out))


def _value(statement: str, known: dict[str, Column], functions: dict[str, Callable[..., Column]]) -> tuple[str, Column]:
    """The name that a statement assigns, and its value."""
    name, sign, text = STATEMENT.match(statement).groups()
    value = compiled(text, known, functions)
    if sign:
        if name not in known:
            raise ExpressionError(f"unknown name {name}")
        value = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide}[sign](known[name], value)
    return name, value.cast("double")


def _with(step: Callable[[Column, Column, str], Column], k: Column, s: str) -> Callable[[Column, Column], Column]:
    return lambda carried, _: step(carried, k, s)


def _folded(loop: str, known: dict[str, Column], functions: dict[str, Callable[..., Column]], scripted: list[str]) -> Column:
    """A loop as one fold over its index, with a struct of the script's variables as what is carried; the plan's size hangs on the text alone.

    scripted: the variables so far. Ones first assigned in the loop start as null. An end that is null, or under 1, runs nothing.
    """
    index, end, text = LOOP.match(loop).groups()
    body = _body(text)
    fields = list(dict.fromkeys([*scripted, *_assigned(body)]))
    if index in fields:
        raise ExpressionError(f"a loop's index is a variable: {index}")
    count = F.coalesce(F.floor(compiled(end, known, functions)).cast("int"), F.lit(0))
    turns = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(*(known.get(f, F.lit(None)).cast("double").alias(f) for f in fields))

    def step(carried: Column, k: Column, s: str) -> Column:
        own = known | {f: carried[f] for f in fields} | {index: k.cast("double")}
        if LOOP.match(s):
            return _folded(s, own, functions, fields)
        name, value = _value(s, own, functions)
        return F.struct(*((value if f == name else carried[f]).alias(f) for f in fields))

    def turn(carried: Column, k: Column) -> Column:
        carried = step(carried, k, body[0])
        for s in body[1:]:
            # A fold of one step: the variables are worked out once, and the next statement reads them by name.
            carried = F.aggregate(F.array(F.lit(0)), carried, _with(step, k, s))
        return carried

    return F.aggregate(turns, start, turn)


def _summed(text: str, pixels: int, known: dict[str, Column], functions: dict[str, Callable[..., Column]]) -> Column:
    """The sum of an expression over windowIdx = 0 .. pixels - 1."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(pixels - 1)), F.lit(0.0), lambda a, k: a + compiled(text, known | {"windowIdx": k.cast("double")}, functions))


def kernel_script(cells: DataFrame, spec: GridSpec, radius: int, bands: list[str], steps: dict[str, str] | list[str] | str, output: str, tables: dict[str, list[list[float]]] | None = None) -> DataFrame:
    """x, y and the output of a script over windows. steps: name to expression, in order; later ones may use earlier names.

    A loop over the window is a step with a {i}: it stands for the sum of its expression over i = 0 .. numPix - 1.
    Steps may also be statements, in a list or in a text divided by semicolons: "name = expression", with +=, -=, *=
    or /= too, and "for k < end: statement" or "for k < end: {statements}", which runs them for k = 0 .. end - 1, where end
    is an expression. Loops may hold loops. A loop is a fold that carries the script's variables, so a loop that reads
    its own variable, however often and over however large a window, keeps a plan of the size of its text.
    """
    pixels = (2 * radius + 1) ** 2
    known = {b: F.col(f"win_{b}") for b in bands} | {"numPix": F.lit(float(pixels)), "centrePixIdx": F.lit(float(pixels // 2)), "xcoord": F.col("x").cast("double"), "ycoord": F.col("y").cast("double")}
    functions = kernel_functions(radius, tables)
    out = windowed(cells, spec, radius, bands)
    if not isinstance(steps, dict):
        statements = _statements(steps) if isinstance(steps, str) else [part for s in steps for part in _statements(s)]
        _assigned(statements)
        scripted: list[str] = []
        for s in statements:
            # Each statement's variables become columns, which the next one names instead of repeating what they are made of.
            if LOOP.match(s):
                names = list(dict.fromkeys([*scripted, *_assigned([s])]))
                out = out.withColumn("__script", _folded(s, known, functions, scripted))
                out = out.withColumns({f"__{n}": F.col("__script")[n] for n in names}).drop("__script")
            else:
                name, value = _value(s, known, functions)
                names = [name]
                out = out.withColumn(f"__{name}", value)
            known |= {n: F.col(f"__{n}") for n in names}
            scripted = list(dict.fromkeys([*scripted, *names]))
        return out.select("x", "y", known[output].alias(output))
    for name, text in steps.items():
        if "{i}" not in text:
            known[name] = compiled(text, known, functions)
            continue
        known[name] = _summed(text.replace("{i}", "windowIdx"), pixels, dict(known), functions)
    return out.select("x", "y", known[output].alias(output))


def tile_model(cells: DataFrame, spec: GridSpec, bands: list[str], model: Callable[..., dict[str, np.ndarray]], schema: str, radius: int = 0) -> DataFrame:
    """A foreign model over the dense arrays of each tile."""
    return over_tiles(cells, spec, radius, bands, model, schema)
