"""SQL over named tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rasterloom.sources.tables import attach

#: Letters of strftime that have a pattern of date_format, and those that have an expression.
PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS"}
EXPRESSIONS = {"w": "CAST(dayofweek(t) - 1 AS STRING)", "s": "CAST(unix_seconds(t) AS STRING)", "J": "CAST(unix_micros(t) / 86400000000D + 2440587.5D AS STRING)"}


def _strftime() -> str:
    """The format f with each letter's part of the time t; %% stands aside meanwhile."""
    out = "replace(f, '%%', '\\u0001')"
    for letter, value in {**{k: f"date_format(t, '{p}')" for k, p in PATTERNS.items()}, **EXPRESSIONS}.items():
        out = f"replace({out}, '%{letter}', {value})"
    return f"replace({out}, '\\u0001', '%')"


def registered(spark: SparkSession) -> None:
    """Session functions for the dialect's own names, as SQL macros: they are inlined into plans."""
    for text in (
        "CREATE OR REPLACE TEMPORARY FUNCTION casttointeger(v STRING) RETURNS BIGINT RETURN try_cast(v AS BIGINT)",
        "CREATE OR REPLACE TEMPORARY FUNCTION casttodouble(v STRING) RETURNS DOUBLE RETURN try_cast(v AS DOUBLE)",
        "CREATE OR REPLACE TEMPORARY FUNCTION casttotext(v STRING) RETURNS STRING RETURN v",
        "CREATE OR REPLACE TEMPORARY FUNCTION julianday(t TIMESTAMP) RETURNS DOUBLE RETURN unix_micros(t) / 86400000000D + 2440587.5D",
        "CREATE OR REPLACE TEMPORARY FUNCTION datetime(t TIMESTAMP) RETURNS STRING RETURN date_format(t, 'yyyy-MM-dd HH:mm:ss')",
        "CREATE OR REPLACE TEMPORARY FUNCTION timeofday(t TIMESTAMP) RETURNS STRING RETURN date_format(t, 'HH:mm:ss')",
        f"CREATE OR REPLACE TEMPORARY FUNCTION strftime(f STRING, t TIMESTAMP) RETURNS STRING RETURN {_strftime()}",
        "CREATE OR REPLACE TEMPORARY FUNCTION glob(p STRING, v STRING) RETURNS BOOLEAN RETURN v RLIKE concat('^', replace(replace(regexp_replace(p, '([.+^$(){}|\\\\\\\\])', '\\\\\\\\$1'), '*', '.*'), '?', '.'), '$')",
        "CREATE OR REPLACE TEMPORARY FUNCTION md5checksum(v STRING) RETURNS STRING RETURN md5(v)",
    ):
        spark.sql(text)


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], statement: str, args: list | dict | None = None) -> DataFrame:
    """The result of one statement over the named tables. Errors are raised; several statements are separated by semicolons, and the last one's result counts."""
    attach(tables)
    # A recursion ends when it finds no more rows, however many it has found (Spark's default raises beyond a million).
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    out = None
    for part in filter(str.strip, re.split(r";\s*(?=(?:[^']*'[^']*')*[^']*$)", statement)):
        out = spark.sql(part, args=args) if args else spark.sql(part)
    return out
