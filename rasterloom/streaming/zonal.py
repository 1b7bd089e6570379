"""Zonal statistics and combinations over cells that arrive bit by bit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.stored import shared_folder


def running_statistics(stream: DataFrame, zone: str = "zone", value: str = "value") -> DataFrame:
    """A streaming aggregate: count, min, max, mean and sum by zone, for update or complete mode. State grows with the zones, not the cells."""
    v = F.col(value)
    return stream.where(F.col(zone).isNotNull() & v.isNotNull()).groupBy(zone).agg(F.count("*").alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sum"))


def running_combinations(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Tuples of values as they are first seen."""
    return stream.select(*columns).dropna().dropDuplicates(columns)


def drained(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and returns the result's table. State and progress are kept under checkpoint, which all executors share.

    The result is a stored table and never passes the driver. In complete mode each batch replaces it; else
    a batch has a folder by its number, so one that is run again writes the same rows once.
    """
    path = f"{shared_folder(result.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    # A source without rows has no batch, and a first one of no rows writes no file: the table is there in any case.
    empty = result.sparkSession.createDataFrame([], result.schema)
    empty.coalesce(1).write.parquet(path if mode == "complete" else f"{path}/batch=-1")
    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path).select(*result.columns)


#: What is carried for a zone: cells seen, and the sums that its statistics need.
_CARRIED = ("cells", "count", "min", "max", "sum")


def completed_zones(stream: DataFrame, sizes: DataFrame, folder: str, zone: str = "zone", value: str = "value") -> DataFrame:
    """zone, count, min, max, mean, sum and batch of each zone, handed out once, in the batch in which the last of its cells came.

    sizes: zone and cells, the number of cells (null values too) that a zone has; zones without an entry, and those
    whose cells don't all come, are never handed out. Each batch is aggregated by zone before anything is shuffled, so a zone
    of very many cells is no single group, and added to what is carried of the open zones, a table by the
    batch's number. A batch that is run again, after a failure or a restart with the same folder, reads what the one before
    it carried and writes the same once more. folder must be shared, and serves one stream; it holds the progress too.
    A null zone counts as none. A stream without rows gives no rows.
    """
    spark = stream.sparkSession
    v = F.col(value)
    fields = {f.name: f.dataType for f in stream.schema.fields}
    carried = f"zone {fields[zone].simpleString()}, cells long, `count` long, `min` {fields[value].simpleString()}, `max` {fields[value].simpleString()}, `sum` double"
    done = f"zone {fields[zone].simpleString()}, `count` long, `min` {fields[value].simpleString()}, `max` {fields[value].simpleString()}, mean double, `sum` double"
    spark.createDataFrame([], carried).coalesce(1).write.mode("overwrite").parquet(f"{folder}/open/-1")
    spark.createDataFrame([], done).coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col(zone).isNotNull()).groupBy(F.col(zone).alias("zone")).agg(F.count("*").alias("cells"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v.cast("double")).alias("sum"))
        both = spark.read.schema(carried).parquet(f"{folder}/open/{number - 1}").unionByName(new)
        merged = both.groupBy("zone").agg(F.sum("cells").alias("cells"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))
        known = merged.join(sizes.select("zone", F.col("cells").alias("whole")), "zone", "left")
        whole = F.coalesce(F.col("cells") >= F.col("whole"), F.lit(False))
        # Written once, by whether a zone is whole; both tables are parts of it.
        known.select("zone", *_CARRIED, whole.alias("whole")).write.mode("overwrite").parquet(f"{folder}/all/{number}")
        kept = spark.read.parquet(f"{folder}/all/{number}")
        kept.where("NOT whole").drop("whole").write.mode("overwrite").parquet(f"{folder}/open/{number}")
        kept.where("whole").select("zone", "count", "min", "max", F.try_divide("sum", "count").alias("mean"), "sum").write.mode("overwrite").parquet(f"{folder}/done/batch={number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{done}, batch int").parquet(f"{folder}/done")
