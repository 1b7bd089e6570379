"""Attribute tables: reading, importing and exporting text files, names in the catalogue."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalised(df: DataFrame) -> DataFrame:
    """The three column kinds of attribute tables: whole numbers as long, other numbers as double, anything else as text."""

    def kind(t: T.DataType) -> str:
        if isinstance(t, T.IntegralType):
            return "long"
        return "double" if isinstance(t, (T.FractionalType, T.DecimalType)) else "string"

    return df.select(*(F.col(f"`{f.name}`").cast(kind(f.dataType)).alias(f.name) for f in df.schema))


def key_of(df: DataFrame, declared: str | None = None) -> str:
    """The key column: the declared one, else rowidx, else the first of whole numbers."""
    if declared:
        return declared
    if "rowidx" in df.columns:
        return "rowidx"
    for f in df.schema:
        if isinstance(f.dataType, T.IntegralType):
            return f.name
    raise ValueError("no column of whole numbers: name a key")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A stored table; only the named columns and the rows that fit are read."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def import_delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Comma-separated text with a header and double quotes. Without a schema, kinds are inferred, which reads the file twice."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    return reader.schema(schema).csv(path) if schema is not None else normalised(reader.option("inferSchema", True).csv(path))


def export_delimited(df: DataFrame, path: str, where: str | None = None) -> None:
    """Comma-separated text with a header and strings in single quotes; the selected rows only."""
    (df.where(where) if where else df).write.mode("overwrite").option("header", True).option("quote", "'").option("quoteAll", True).csv(path)


def imported_if_stale(spark: SparkSession, source: str, store: str) -> DataFrame:
    """The stored import of a text file, made anew if the file has changed since."""
    held = _changed(spark, store)
    if held is None or held < _changed(spark, source):
        import_delimited(spark, source).write.mode("overwrite").parquet(store)
    return spark.read.parquet(store)


def _changed(spark: SparkSession, path: str):
    """When the files under a path were last written; null without any. Their contents are not read."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max("modificationTime")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def opened(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A table by its file's kind: Parquet, ORC or JSON as they are, .csv and .txt as delimited text."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt"):
        return import_delimited(spark, path, schema)
    if kind not in ("parquet", "orc", "json"):
        raise ValueError(f"unknown kind of table: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(kind).load(path)


def attach(tables: dict[str, DataFrame]) -> None:
    """Makes tables known to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def detach(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.catalog.dropTempView(name)


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def described(spark: SparkSession, names: list[str]) -> DataFrame:
    """name, columns and rows of each of the catalogue's tables named; each is counted by Spark."""
    out = None
    for name in names:
        df = spark.table(name)
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(len(df.columns)).alias("columns"), "rows")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "name string, columns int, rows long") if out is None else out


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def evaluate(df: DataFrame) -> None:
    """Runs a plan without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()
