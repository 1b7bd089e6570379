"""Sorting cells and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.zonal import numbered
from rasterloom.sources.grids import GridSpec


def sorted_cells(cells: DataFrame, spec: GridSpec, value: str = "value", ascending: bool = True, dependent: list[str] | None = None) -> DataFrame:
    """rank (from 0), index (the value's original offset), the value and dependent bands in the value's order; ties keep the order of their offsets, nulls come first.

    Spark's range partitioning sorts pieces apart and spills; ranks come from the pieces' sizes.
    """
    offset = (F.col("y").cast("long") * spec.width + F.col("x")).alias("index")
    rows = cells.select(offset, F.col(value), *(dependent or []))
    key = F.struct(F.col(value).alias("v"), F.col("index")) if ascending else F.struct((-F.col(value)).alias("v"), F.col("index"))
    return numbered(rows.withColumn("__key", key), "__key", "rank").drop("__key")


def sorted_table(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col(column).asc() if ascending else F.col(column).desc())
