"""Grids of cells: a grid is a DataFrame of x, y (and z) and values, beside the GridSpec of its extent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.expressions import drawn


@dataclass(frozen=True)
class GridSpec:
    """Extent of a grid: columns, rows, place of cell (0, 0) and size of a cell."""

    width: int
    height: int
    origin: tuple[float, float] = (0.0, 0.0)
    spacing: tuple[float, float] = (1.0, 1.0)

    def same_cells(self, other: GridSpec) -> None:
        """Raises unless cells of both grids correspond one to one."""
        if (self.width, self.height) != (other.width, other.height):
            raise ValueError(f"grids differ in size: {self.width} x {self.height} and {other.width} x {other.height}")


def cells_of(table: DataFrame, index: str, width: int, *values: str) -> DataFrame:
    """Rows numbered along grid lines as cells: x, y and the value columns."""
    return table.select((F.col(index) % width).cast("int").alias("x"), F.floor(F.col(index) / width).cast("int").alias("y"), *values)


def read_cells(spark: SparkSession, path: str, bands: list[str] | None = None, nodata: float | None = None) -> DataFrame:
    """A stored grid, with only the named bands read; nodata becomes null."""
    df = spark.read.parquet(path)
    keys = [c for c in ("x", "y", "z") if c in df.columns]
    bands = bands or [c for c in df.columns if c not in (*keys, "tx", "ty")]
    return df.select(*keys, *(F.when(F.col(b) == F.lit(nodata), None).otherwise(F.col(b)).alias(b) if nodata is not None else F.col(b) for b in bands))


def write_cells(cells: DataFrame, path: str, tile: int = 1024, mode: str = "overwrite") -> None:
    """Stores a grid by tiles, so that a region's reader skips the other tiles' folders."""
    tiled = cells.withColumns({"tx": F.floor(F.col("x") / tile).cast("int"), "ty": F.floor(F.col("y") / tile).cast("int")})
    tiled.repartition("tx", "ty").write.mode(mode).partitionBy("tx", "ty").parquet(path)


def region(cells: DataFrame, x: int, y: int, width: int, height: int, shift: bool = True) -> DataFrame:
    """The cells of a rectangle; with shift, counted from its corner."""
    out = cells.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return out.withColumns({"x": F.col("x") - x, "y": F.col("y") - y}) if shift else out


def region_at(cells: DataFrame, spec: GridSpec, origin: tuple[float, float], length: tuple[float, float]) -> DataFrame:
    """The same by physical corner and side lengths."""
    first = [round((o - s) / d) for o, s, d in zip(origin, spec.origin, spec.spacing, strict=True)]
    return region(cells, *first, *(max(1, round(n / d)) for n, d in zip(length, spec.spacing, strict=True)))


def update_region(cells: DataFrame, patch: DataFrame) -> DataFrame:
    """cells with those of patch in place of the ones they cover."""
    return cells.join(patch.select("x", "y"), ["x", "y"], "left_anti").unionByName(patch)


def overview(cells: DataFrame, level: int, value: str = "value", how: str = "avg") -> DataFrame:
    """A pyramid's level: cells of 2**level by 2**level, averaged, or the first or most frequent value."""
    side = 1 << level
    functions = {"avg": F.avg(value), "first": F.min_by(value, F.struct("y", "x")), "mode": F.mode(value, deterministic=True)}
    return cells.groupBy(F.floor(F.col("x") / side).cast("int").alias("x"), F.floor(F.col("y") / side).cast("int").alias("y")).agg(functions[how].alias(value))


def random_cells(spark: SparkSession, spec: GridSpec, low: float, high: float, seed: int) -> DataFrame:
    """Values between low and high by hash of the seed and the cell: the same on every cluster."""
    cells = cells_of(spark.range(spec.width * spec.height), "id", spec.width)
    return cells.withColumn("value", F.lit(low) + F.lit(high - low) * drawn(seed, F.col("x"), F.col("y")))


def to_table(cells: DataFrame, image: str, value: str = "value", dims: dict[str, str] | None = None, auxiliary: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells as rows of a table: <dim>_id for each index, the value under the image's name, and auxiliary variables looked up by index."""
    dims = dims or {"x": "x", "y": "y"}
    out = cells.select(*(F.col(c).cast("long").alias(f"{d}_id") for d, c in dims.items()), F.col(value).alias(image))
    for name, axis in (auxiliary or {}).items():
        out = out.join(axis, [c for c in axis.columns if c != name], "left")
    return out


def update_table(table: DataFrame, image: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Update mode: values of image replace those of table under equal indices; other rows stay."""
    new = image.select(*keys, F.col(column).alias("__new"))
    return table.join(new, keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def to_grid(table: DataFrame, spec: GridSpec, x: str, y: str, value: str, where: str | None = None, fill: float | None = None) -> DataFrame:
    """A dense grid from a table's rows: x, y, value; cells without a row get fill. Of rows of one cell the largest value counts."""
    spark = table.sparkSession
    rows = (table.where(where) if where else table).where(F.col(x).between(0, spec.width - 1) & F.col(y).between(0, spec.height - 1))
    found = rows.groupBy(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y")).agg(F.max(value).alias("value"))
    every = cells_of(spark.range(spec.width * spec.height), "id", spec.width)
    out = every.join(found, ["x", "y"], "left")
    return out if fill is None else out.fillna({"value": fill})


def slice_to_cube(cells: DataFrame, z: int, dims: tuple[int, int, int] = (1, 2, 0)) -> DataFrame:
    """A 2-D grid as a slice of a cube. dims: for x, y and z of the cube, which of the grid's axes (1, 2) it is; 0 for the fixed one."""
    source = {0: F.lit(z), 1: F.col("x"), 2: F.col("y")}
    return cells.select(*(source[d].cast("int").alias(n) for n, d in zip("xyz", dims, strict=True)), *(c for c in cells.columns if c not in ("x", "y")))


def cube_to_slice(cube: DataFrame, z: int) -> DataFrame:
    return cube.where(F.col("z") == z).drop("z")


def hyperslab(cube: DataFrame, start: dict[str, int], size: dict[str, int]) -> DataFrame:
    """The part of a grid of any number of dimensions from start, size cells long in each."""
    for name, lo in start.items():
        cube = cube.where(F.col(name).between(lo, lo + size[name] - 1))
    return cube
