"""Aggregates over zones and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.sources.stored import stored


def zonal_statistics(cells: DataFrame, zone: str = "zone", value: str | None = "value", ignore_null: bool = True, every_key: bool = False) -> DataFrame:
    """Per zone: rowidx (the zone), zone_id (its ordinal), count, min, max, mean, population stddev, sum of values, and extent in cells.

    Without a value column the zone is its own value. every_key adds the absent zones 0 to the largest, with
    zone_id -1 and zeros. One shuffle, of partial aggregates; the ordinal is taken over zones, not cells.
    """
    v = F.col(value or zone).cast("double")
    rows = cells.where(F.col(zone).isNotNull())
    if ignore_null:
        rows = rows.where(v.isNotNull())
    out = rows.groupBy(F.col(zone).cast("long").alias("rowidx")).agg(
        F.count("*").alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.sum(v).alias("sum"),
        F.min("x").alias("minX"), F.min("y").alias("minY"), F.max("x").alias("maxX"), F.max("y").alias("maxY"),
    )
    out = numbered(out, "rowidx", "zone_id")
    if not every_key:
        return out
    spark = cells.sparkSession
    top = out.agg(F.max("rowidx")).first()[0]
    every = spark.range(0, (-1 if top is None else top) + 1).withColumnRenamed("id", "rowidx")
    filled = every.join(out, "rowidx", "left")
    return filled.select("rowidx", *(F.coalesce(c, F.lit(-1 if c == "zone_id" else 0).cast(t)).alias(c) for c, t in out.drop("rowidx").dtypes))


#: Low bits of monotonically_increasing_id that count within a partition.
PLACE_BITS = 33


def numbered(df: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """Ordinals of distinct keys in ascending order, without bringing the rows into one task.

    Ranges of the key are sorted apart; each range's first ordinal is the sum of the sizes before it, and
    those few sizes are what meets in one place.
    """
    # The id of a sorted row holds its part and its place in it. Stored, because both uses must see the same ranges.
    placed = stored(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", PLACE_BITS))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + place + start).cast("long")).drop("__part", "__id", "__before")


def column_statistics(df: DataFrame, column: str, where: str | None = None, sample: bool = False) -> DataFrame:
    """count, minimum, maximum, mean, stddev and sum of a column's values; with sample also the median, and the deviation of a sample."""
    c = F.col(column).cast("double")
    rows = (df.where(where) if where else df).where(c.isNotNull())
    deviation = F.stddev_samp(c) if sample else F.stddev_pop(c)
    more = [F.median(c).alias("median")] if sample else []
    return rows.agg(F.count(c).alias("count"), F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.avg(c).alias("mean"), deviation.alias("stddev"), F.sum(c).alias("sum"), *more)


def median(df: DataFrame, column: str) -> DataFrame:
    """The median of a column's values, one row: of the two middle ones the mean. Ranges are sorted apart; no task holds all values."""
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    ranked = numbered(rows.withColumn("__key", F.struct("v", F.monotonically_increasing_id())), "__key", "__at")
    ends = rows.agg(F.count("*").alias("__all"))
    middle = F.col("__at").between(F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2))
    return ranked.join(F.broadcast(ends)).where(middle).agg(F.avg("v").alias("median"))


def histogram(df: DataFrame, column: str, bins: int = 256) -> DataFrame:
    """bin (from 0), low edge and count over equal steps between the smallest and largest value; bins without values are left out."""
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    rows = df.where(c.isNotNull()).select(c.alias("v")).join(F.broadcast(ends))
    step = (F.col("hi") - F.col("lo")) / bins
    placed = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), step)), F.lit(bins - 1)))
    return rows.groupBy(placed.cast("int").alias("bin")).agg(F.min(F.col("lo") + step * placed).alias("low"), F.count("*").alias("count"))


def normalised_columns(df: DataFrame, columns: list[str], cost: bool = False, where: str | None = None) -> DataFrame:
    """<column>_N for each column: scaled by the smallest and largest value of all of them together; turned round for costs. Rows not selected get null."""
    chosen = F.expr(where) if where else F.lit(True)
    ends = df.where(chosen).agg(F.least(*(F.min(c) for c in columns)) if len(columns) > 1 else F.min(columns[0]), F.greatest(*(F.max(c) for c in columns)) if len(columns) > 1 else F.max(columns[0])).toDF("__lo", "__hi")
    out = df.join(F.broadcast(ends))
    for c in columns:
        part = F.col("__hi") - F.col(c) if cost else F.col(c) - F.col("__lo")
        out = out.withColumn(f"{c}_N", F.when(chosen, F.try_divide(part.cast("double"), F.col("__hi") - F.col("__lo"))))
    return out.drop("__lo", "__hi")


def value_classes(df: DataFrame, column: str, low: float, high: float, classes: int = 256) -> DataFrame:
    """The class of each value on a ramp from low to high; values outside fall into the end classes."""
    return df.withColumn("class", F.greatest(F.lit(0), F.least(F.lit(classes - 1), F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(classes)) - 1)).cast("int"))


def wide(df: DataFrame, key: str, attribute: str, value: str, names: list[str]) -> DataFrame:
    """Attribute-value rows as one row a key, with a column for each of the given names."""
    return df.groupBy(key).pivot(attribute, names).agg(F.min(value))
