"""Cell by cell: overlays of grids, look-ups in attribute tables, map algebra, land-use potentials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.expressions import compiled, split_list
from rasterloom.sources.grids import GridSpec

#: Ranges of the output kinds that clamp.
RANGES = {"byte": (-128, 127), "short": (-32768, 32767), "int": (-2147483648, 2147483647), "ubyte": (0, 255), "ushort": (0, 65535), "uint": (0, 4294967295)}


def overlay(grids: dict[str, DataFrame], value: str = "value", specs: dict[str, GridSpec] | None = None) -> DataFrame:
    """Aligned grids side by side: x, y and a column for each grid, joined on the cell.

    Grids of different sizes are an error: by their specs where these are given, and else by a cell that
    one grid has and another lacks, which fails the job that meets it.
    """
    for spec in list((specs or {}).values())[1:]:
        next(iter(specs.values())).same_cells(spec)
    named = [df.select("x", "y", F.col(value).alias(name)) for name, df in grids.items()]
    if specs is not None or len(named) < 2:
        return reduce(lambda a, b: a.join(b, ["x", "y"]), named)
    marked = [df.withColumn(f"__in{k}", F.lit(True)) for k, df in enumerate(named)]
    every = reduce(lambda a, b: a.join(b, ["x", "y"], "full"), marked)
    missing = reduce(lambda a, b: a | b, (F.col(f"__in{k}").isNull() for k in range(len(named))))
    checked = every.withColumn("x", F.when(missing, F.raise_error(F.lit("grids differ in their cells")).cast("int")).otherwise(F.col("x")))
    return checked.select("x", "y", *grids)


def looked_up(cells: DataFrame, band: str, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Attributes of the row whose key is the band's value, as <band>__<column>; null without such a row.

    Spark broadcasts the table if it is small by its own threshold, and shuffles both sides otherwise.
    """
    chosen = table.select(F.col(key).alias("__key"), *(F.col(c).alias(f"{band}__{c}") for c in columns))
    return cells.join(chosen, F.col(band) == F.col("__key"), "left").drop("__key")


def variables(cells: DataFrame, spec: GridSpec) -> dict[str, Column]:
    """What an expression may name: bands as doubles, text attributes as they are, and the cell's index and place."""
    text = {n for n, t in cells.dtypes if t == "string"}
    out = {c: F.col(c) if c in text else F.col(c).cast("double") for c in cells.columns}
    out |= {"idxX": F.col("x").cast("double"), "idxY": F.col("y").cast("double")}
    out |= {"idxPhyX": F.lit(spec.origin[0]) + F.col("x") * spec.spacing[0], "idxPhyY": F.lit(spec.origin[1]) + F.col("y") * spec.spacing[1]}
    return out


def map_algebra(cells: DataFrame, spec: GridSpec, expressions: str, kind: str = "double", functions: dict | None = None) -> DataFrame:
    """x, y and one column (out1, out2, ...) for each of the expressions separated by commas.

    Whole-number kinds clamp to their range and round to zero; null stays null.
    """
    known = variables(cells, spec)
    out = []
    for k, text in enumerate(split_list(expressions), 1):
        c = compiled(text, known, functions)
        if kind in RANGES:
            lo, hi = RANGES[kind]
            c = clamped(c, lo, hi).cast({"byte": "tinyint", "short": "smallint", "int": "int", "ubyte": "smallint", "ushort": "int", "uint": "bigint"}[kind])
        else:
            c = c.cast(kind)
        out.append(c.alias(f"out{k}"))
    return cells.select("x", "y", *out)


def clamped(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def clamp_counts(cells: DataFrame, column: str, kind: str) -> DataFrame:
    """How many values lie under and over a kind's range."""
    lo, hi = RANGES[kind]
    return cells.agg(F.count_if(F.col(column) < lo).alias("underflow"), F.count_if(F.col(column) > hi).alias("overflow"))


def potentials(cells: DataFrame, potential: list[str], categories: list[int], mask: str | None = None) -> DataFrame:
    """category and potential of the largest potential of each cell; the first of equal ones, 0 if none is positive. A mask other than 0 is the category, of potential 0."""
    best, category = F.lit(0.0), F.lit(0)
    for c, k in zip(potential, categories, strict=True):
        better = F.col(c) > best
        category, best = F.when(better, F.lit(k)).otherwise(category), F.when(better, F.col(c)).otherwise(best)
    if mask is not None:
        masked = F.coalesce(F.col(mask), F.lit(0)) != 0
        category, best = F.when(masked, F.col(mask)).otherwise(category), F.when(masked, F.lit(0.0)).otherwise(best)
    return cells.withColumns({"category": category.cast("int"), "potential": best.cast("double")})


def allocated(cells: DataFrame, thresholds: dict[int, float], category: str = "category", potential: str = "potential") -> DataFrame:
    """Categories set to 0 where the potential is under the category's threshold."""
    under = reduce(lambda a, b: a | b, ((F.col(category) == k) & (F.col(potential) < t) for k, t in thresholds.items()), F.lit(False))
    return cells.withColumn(category, F.when(under, 0).otherwise(F.col(category)).cast("int"))


def band(cells: DataFrame, name: str) -> DataFrame:
    """One band of a grid of several."""
    return cells.select("x", "y", F.col(name).alias("value"))
