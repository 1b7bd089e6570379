"""Combinations of values of aligned grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.zonal import numbered

LONG_MAX = (1 << 63) - 1


def combination_code(values: list[Column], domains: list[int]) -> Column:
    """1 + sum of value * product of the earlier domains; 0 if any value is null. Raises if the codes don't fit a long."""
    if reduce(lambda a, b: a * b, domains, 1) > LONG_MAX - 1:
        raise OverflowError("the domains' product exceeds a long")
    code, stride = F.lit(1).cast("long"), 1
    for v, n in zip(values, domains, strict=True):
        code, stride = code + v.cast("long") * F.lit(stride).cast("long"), stride * n
    return F.coalesce(code, F.lit(0).cast("long"))


def combine(cells: DataFrame, columns: list[str], domains: list[int]) -> tuple[DataFrame, DataFrame]:
    """Cells with their combination's code; and the table of combinations: rowidx (the code), UvId (from 0, by code) and the values."""
    coded = cells.withColumn("code", combination_code([F.col(c) for c in columns], domains))
    found = coded.where("code > 0").select(F.col("code").alias("rowidx"), *columns).distinct()
    return coded, numbered(found, "rowidx", "UvId")


def decoded(table: DataFrame, columns: list[str], domains: list[int], code: str = "rowidx") -> DataFrame:
    """The values that a code stands for."""
    rest = F.col(code) - 1
    out = table
    for c, n in zip(columns, domains, strict=True):
        out, rest = out.withColumn(c, rest % n), F.floor(rest / n)
    return out


def unique_combinations(cells: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells with comb, the number (from 1) of their tuple of values; and the table of tuples: rowidx, the values, count. Tuples with nulls are left out.

    Tuples are grouped before they are numbered, and the cells join the small table back.
    """
    tuples = cells.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("count"))
    table = numbered(tuples.withColumn("__key", F.struct(*columns)), "__key", "rowidx", 1).drop("__key")
    return cells.join(table.drop("count").withColumnRenamed("rowidx", "comb"), columns, "left"), table
