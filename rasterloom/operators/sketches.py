"""Approximate statistics that can be merged: sketches by tile and zone, stored once, put together for any region of tiles.

A sketch has a bounded size whatever the number of cells, and those of a tile and zone are aggregated before they are
shuffled. Statistics of another region, or of all, merge stored sketches and read no cell again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.stored import stored

#: Size of the distinct counts' sketches, as a power of two of registers, and of the quantiles'; the errors below are theirs.
DISTINCT_BITS, QUANTILE_K = 12, 400
#: Relative standard error of a distinct count (1.04 / sqrt(registers)), and the error of a quantile's rank at 99 percent.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (DISTINCT_BITS / 2), 0.0083


def sketched(cells: DataFrame, zone: str, value: str, distinct: str, tile: int = 256) -> DataFrame:
    """tx, ty, zone, values and distincts: for each tile and zone a sketch of the values' quantiles and one of the distinct entries of another column; stored.

    Null values and entries are left out; a null zone is a zone. Cells of a tile and zone without any value have a null sketch. An empty grid gives no rows.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    own = cells.select(at("x").alias("tx"), at("y").alias("ty"), F.col(zone).alias("zone"), F.col(value).cast("double").alias("v"), F.col(distinct).alias("d"))
    found = own.groupBy("tx", "ty", "zone").agg(
        F.count("v").alias("n"),
        F.kll_sketch_agg_double("v", QUANTILE_K).alias("values"),
        F.hll_sketch_agg("d", DISTINCT_BITS).alias("distincts"),
    )
    return stored(found.withColumn("values", F.when(F.col("n") > 0, F.col("values"))).drop("n"))


def merged(sketches: DataFrame, quantiles: list[float], where: str = "true") -> DataFrame:
    """zone, count (exact), distinct (estimated) and q: the values at the quantiles (estimated), for each zone over the tiles that `where` picks.

    A zone without values has a null q and a count of 0.
    """
    own = sketches.where(where).groupBy("zone").agg(F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("distincts").alias("distincts"), F.count("values").alias("some"))
    some = F.when(F.col("some") > 0, F.col("values"))
    ranks = F.array(*map(F.lit, quantiles))
    return own.select("zone", F.coalesce(F.kll_sketch_get_n_double(some), F.lit(0)).cast("long").alias("count"), F.hll_sketch_estimate("distincts").alias("distinct"), F.kll_sketch_get_quantile_double(some, ranks).alias("q"))
