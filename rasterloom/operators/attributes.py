"""Operators on attribute tables. Each returns a new DataFrame; nothing is changed in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.expressions import compiled
from rasterloom.functions.text import predicate


def fetched(df: DataFrame, columns: list[str], where: str | None = None, distinct: bool = False, args: list | None = None) -> DataFrame:
    """Columns of the rows that fit; the condition may hold ? for args."""
    if where and args:
        rows = df.sparkSession.sql(f"SELECT * FROM {{df}} WHERE {where}", args=args, df=df)
    else:
        rows = df.where(where) if where else df
    out = rows.select(*columns)
    return out.distinct() if distinct else out


def row_count(df: DataFrame, where: str | None = None) -> DataFrame:
    return (df.where(where) if where else df).agg(F.count("*").alias("n"))


def looked_up_value(df: DataFrame, column: str, key: str, value) -> DataFrame:
    """The column in the row of a key."""
    return df.where(F.col(key) == F.lit(value)).select(column)


def row_of(df: DataFrame, key: str, column: str, value) -> DataFrame:
    """The smallest key whose column has the value."""
    return df.where(F.col(column) == F.lit(value)).agg(F.min(key).alias(key))


def key_range(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def with_column(df: DataFrame, name: str, kind: str, value=None) -> DataFrame:
    return df.withColumn(name, F.lit(value).cast(kind))


def upserted(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows in place of those of equal keys, and added where there are none."""
    return df.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def updated(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values of rows under equal keys, where they aren't null; rows without a match are left as they are. Keys of rows are unique."""
    columns = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in columns))
    out = df.join(new, keys, "left")
    return out.withColumns({c: F.coalesce(f"__new_{c}", c) for c in columns}).drop(*(f"__new_{c}" for c in columns)).select(*df.columns)


def set_where(df: DataFrame, column: str, value, where: str) -> DataFrame:
    return df.withColumn(column, F.when(F.expr(where), F.lit(value)).otherwise(F.col(column)))


def calculated(df: DataFrame, column: str, sql: str, where: str | None = None) -> DataFrame:
    """The field calculator by SQL: the selected rows get the expression's value."""
    new = F.expr(sql)
    if where is not None:
        new = F.when(F.expr(where), new).otherwise(F.col(column) if column in df.columns else F.lit(None))
    return df.withColumn(column, new)


def calculated_by_expression(df: DataFrame, column: str, text: str) -> DataFrame:
    """The field calculator by a numeric expression over the columns."""
    return df.withColumn(column, compiled(text, {c: F.col(c).cast("double") for c, t in df.dtypes if t != "string"}))


def calculated_text(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """The field calculator for text: of the terms, columns or literals, the last one counts."""
    last = terms[-1]
    return df.withColumn(column, F.col(last).cast("string") if last in df.columns else F.lit(last))


def terms_selected(terms: list[tuple[str, str, list]], joiners: list[str]) -> Column:
    """Comparison terms joined by && and ||; && binds tighter."""
    groups: list[list[Column]] = [[]]
    for k, (column, operator, values) in enumerate(terms):
        if k and joiners[k - 1] == "||":
            groups.append([])
        groups[-1].append(predicate(F.col(column), operator, values))
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups))


def selected(df: DataFrame, where: str) -> DataFrame:
    return df.where(where)


def inverse_selected(df: DataFrame, where: str) -> DataFrame:
    """Rows for which the condition is false; those for which it is unknown belong to neither selection."""
    return df.where(~F.expr(where))


def composed_selection(df: DataFrame, query: str, base: str, key: str, picked: DataFrame) -> DataFrame:
    """Rows that fit query and base, or whose key was picked."""
    marked = df.join(picked.select(F.col(key).alias("__picked")).distinct(), F.col(key) == F.col("__picked"), "left")
    return marked.where((F.expr(query) & F.expr(base)) | F.col("__picked").isNotNull()).drop("__picked")


def containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose text has the given one within it, in any case."""
    return df.where(F.contains(F.lower(F.col(column).cast("string")), F.lit(text.lower())))


def appended_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n more rows with the next keys and nulls."""
    top = df.agg(F.coalesce(F.max(key), F.lit(-1)).alias("__top"))
    more = df.sparkSession.range(1, n + 1).join(F.broadcast(top)).select((F.col("__top") + F.col("id")).cast(df.schema[key].dataType).alias(key))
    return df.unionByName(more, allowMissingColumns=True)


def deleted(df: DataFrame, where: str) -> DataFrame:
    """Rows but those for which the condition is true."""
    return df.where(~F.coalesce(F.expr(where), F.lit(False)))


def joined(target: DataFrame, source: DataFrame, key: str, source_key: str, fields: list[str]) -> DataFrame:
    """The target with chosen fields of the source under equal keys; without a match they are null."""
    chosen = source.select(F.col(source_key).alias("__key"), *(F.col(f) for f in fields))
    return target.join(chosen, F.col(key) == F.col("__key"), "left").drop("__key")


def joined_last(target: DataFrame, source: DataFrame, key: str, source_key: str, row: str, fields: list[str], defaults: dict | None = None) -> DataFrame:
    """As joined(), but keys compare as text, of source rows of one key the last by `row` counts, quotes round texts go, and rows without a match get defaults."""
    text = {f for f, t in source.dtypes if t == "string"}
    bare = {f: F.regexp_replace(F.col(f), r"""^['"]|['"]$""", "") if f in text else F.col(f) for f in fields}
    last = source.groupBy(F.col(source_key).cast("string").alias("__key")).agg(F.max_by(F.struct(*(bare[f].alias(f) for f in fields)), F.col(row)).alias("__last"))
    out = target.join(last, F.col(key).cast("string") == F.col("__key"), "left")
    pick = {f: F.when(F.col("__key").isNull(), F.lit((defaults or {}).get(f))).otherwise(F.col(f"__last.{f}")) for f in fields}
    return out.withColumns(pick).drop("__key", "__last")


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on all columns of one name."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)
