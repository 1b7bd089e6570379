"""Tiles as rows, and a table function for SQL that turns them into cells again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tiled(cells: DataFrame, value: str, size: int) -> DataFrame:
    """A row for each tile of size x size cells that holds a cell: left, top, width, and its values row by row, null where there is no cell or no data.

    A tile holds a fixed number of values, so no group grows with the grid. Of cells of one place the largest
    value counts; cells without a place have none.
    """
    at = F.pmod(F.col("y"), F.lit(size)) * size + F.pmod(F.col("x"), F.lit(size))
    placed = cells.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    placed = placed.select((F.col("x") - F.pmod(F.col("x"), F.lit(size))).alias("left"), (F.col("y") - F.pmod(F.col("y"), F.lit(size))).alias("top"), at.alias("at"), F.col(value).cast("double").alias("v"))
    one = placed.groupBy("left", "top", "at").agg(F.max("v").alias("v"))
    held = one.groupBy("left", "top").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    return held.select("left", "top", F.lit(size).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.try_element_at("m", i)).alias("cells"))


class TileCells:
    """x, y and value of each cell with data of a table of tiles, and its tile's left and top. Tiles that lack a place, a width or values have none."""

    def eval(self, tiles: pa.RecordBatch):
        left, top, width, cells = (tiles.column(n) for n in ("left", "top", "width", "cells"))
        whole = left.is_valid().to_numpy(False) & top.is_valid().to_numpy(False) & width.is_valid().to_numpy(False) & cells.is_valid().to_numpy(False)
        left, top, width, cells = (c.filter(pa.array(whole)) for c in (left, top, width, cells))
        values, n = cells.flatten(), np.diff(cells.offsets.to_numpy())
        tile = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(tile)) - np.repeat(np.cumsum(n) - n, n)
        held = values.is_valid().to_numpy(False)
        tile, at, values = tile[held], at[held], values.filter(pa.array(held))
        x, y, w = (c.to_numpy(False).astype(np.int32)[tile] for c in (left, top, width))
        yield pa.table({"x": (x + at % w).astype(np.int32), "y": (y + at // w).astype(np.int32), "value": values.cast(pa.float64()), "left": x, "top": y})


def registered_tile_cells(spark: SparkSession, name: str = "tile_cells") -> None:
    """Enters the table function: FROM tile_cells(TABLE(tiles)). It works where the tiles lie, batch by batch; Arrow functions can't be joined laterally, so a tile's other columns are joined by left and top."""
    spark.udtf.register(name, F.arrow_udtf(TileCells, returnType="x int, y int, value double, left int, top int"))
