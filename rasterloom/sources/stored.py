"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it. Where it is unset, a local session gets a folder of its own; on a cluster that is an error, since executors don't share local folders."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written out and read back: later plans start from its files, and every reader sees the same rows."""
    path = f"{shared_folder(df.sparkSession)}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def emptied(df: DataFrame) -> None:
    """Empties a table made by stored(), once nothing reads it any more."""
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(df.stored_path)


def created_table(df: DataFrame) -> DataFrame:
    """df as a stored table of the session's catalogue, under a name of its own: what CREATE TABLE AS does, with its files in the shared folder."""
    name = f"created_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{shared_folder(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


class NotUnique(ValueError):
    """Rows share a key that an index says is unique."""


def indexed_table(df: DataFrame, keys: list[str], buckets: int, unique: bool = False) -> DataFrame:
    """df stored in the shared folder with an index on keys: dealt to buckets by them and sorted within.

    A look-up by all keys reads one bucket, of which the sorted row groups leave out most; tables indexed alike on the
    columns of a join, or of a grouping, are joined or grouped without a shuffle. unique: raises NotUnique if rows share
    a key, where a key with a null in it is shared by none. Buckets are a choice for the table's size: some 128 MB each.
    """
    spark = df.sparkSession
    if unique:
        whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
        shared = df.where(whole).groupBy(*keys).count().where("count > 1").drop("count").first()
        if shared is not None:
            raise NotUnique(f"rows share the key {shared}")
    name = f"indexed_{uuid.uuid4().hex}"
    # Each bucket is written by one task, so that it is one sorted file.
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
