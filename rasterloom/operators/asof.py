"""As-of joins: each row with the last row of the other side at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.sources.stored import stored


def asof_joined(left: DataFrame, right: DataFrame, by: str, at: str, columns: list[str], right_by: str | None = None, right_at: str | None = None, forward: bool = False, inclusive: bool = True, how: str = "left", parts: int | None = None) -> DataFrame:
    """left with the named columns of the last row of right of the same `by` whose time is at or before the row's own.

    forward: the first row at or after it instead. inclusive: whether an equal time counts. how: left keeps rows
    without a match, with nulls; inner leaves them out. Null keys and null times match nothing. Of right's rows of one
    key and time the last (forward: the first) by `columns` counts. Repeated rows of left stay as they are.

    Both sides are sorted together by ranges of key and time, so a key of very many rows is many ranges; the last row
    of right is carried along within a range, and from range to range for the one key that goes on, which takes a row a range.
    """
    right_by, right_at = right_by or by, right_at or at
    own, names = F.struct(*(F.col(f"`{c}`") for c in left.columns)), [f"`{c}`" for c in left.columns]
    rows = left.select(F.col(by).alias("k"), F.col(at).alias("t"), own.alias("own")).withColumn("other", F.lit(None))
    given = right.where(F.col(right_by).isNotNull() & F.col(right_at).isNotNull())
    given = given.select(F.col(right_by).alias("k"), F.col(right_at).alias("t"), F.lit(None).alias("own"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("other"))
    kind = F.when(F.col("other").isNotNull(), F.lit(0 if inclusive else 1)).otherwise(F.lit(1 if inclusive else 0))
    both = rows.where(F.col("k").isNotNull() & F.col("t").isNotNull()).unionByName(given).withColumn("kind", kind)
    # Rows of one key and time are spread by what they hold; none of left's stands before one of right's that it may match.
    both = both.withColumn("salt", F.xxhash64("own"))
    after = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    order = [after("t"), F.col("kind").asc(), after("other"), F.col("salt").asc()]
    ranged = both.repartitionByRange(*([parts] if parts else []), F.col("k").asc(), *order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("part", "k").orderBy(*order)
    carried = ranged.withColumn("found", F.last("other", ignorenulls=True).over(upto)).where("own IS NOT NULL")
    # One row a range: its first and last key, and the last row of right that its last key has there.
    ends = ranged.groupBy("part").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    lasts = ranged.where("other IS NOT NULL").join(F.broadcast(ends), "part").where(F.col("k") == F.col("last"))
    place = F.struct("t", "other")
    lasts = lasts.groupBy("part", "k").agg((F.min_by("other", place) if forward else F.max_by("other", place)).alias("other"))
    asked = ends.select("part", F.col("first").alias("k"), F.lit(None).alias("other"), F.lit(0).alias("from"))
    known = lasts.select("part", "k", "other", F.lit(1).alias("from"))
    before = Window.partitionBy("k").orderBy("part", "from")
    carry = asked.unionByName(known).withColumn("carry", F.last("other", ignorenulls=True).over(before)).where("from = 0 AND carry IS NOT NULL").select("part", "k", "carry")
    out = carried.join(F.broadcast(stored(carry)), ["part", "k"], "left").select("own.*", F.coalesce("found", "carry").alias("found"))
    if how == "inner":
        return out.where("found IS NOT NULL").select(*names, *(F.col("found")[c].alias(c) for c in columns))
    lost = left.where(F.col(by).isNull() | F.col(at).isNull()).select(*names, *(F.lit(None).alias(c) for c in columns))
    return out.select(*names, *(F.col("found")[c].alias(c) for c in columns)).unionByName(lost)

