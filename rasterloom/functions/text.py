"""Text functions of parameter expressions, as columns. Flags are 1 or 0; positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_base_name(path: Column) -> Column:
    """The file's name up to its first dot."""
    return F.substring_index(_file(path), ".", 1)


def file_complete_base_name(path: Column) -> Column:
    """The file's name up to its last dot."""
    return F.regexp_replace(_file(path), r"\.[^.]*$", "")


def file_path(path: Column) -> Column:
    """The folder; "." of a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def file_suffix(path: Column) -> Column:
    """What follows the last dot of the file's name; empty without one."""
    return F.regexp_extract(_file(path), r"\.([^.]*)$", 1)


def file_complete_suffix(path: Column) -> Column:
    """What follows the first dot of the file's name; empty without one."""
    return F.regexp_extract(_file(path), r"^[^.]*\.(.*)$", 1)


def str_replace(text: Column, old: Column, new: Column) -> Column:
    return F.replace(text, old, new)


def str_is_empty(text: Column) -> Column:
    return (F.length(text) == 0).cast("int")


def str_length(text: Column) -> Column:
    return F.length(text)


def _items(text: Column, separator: str) -> Column:
    import re

    return F.filter(F.split(text, re.escape(separator)), lambda x: x != "")


def str_list_item(text: Column, separator: str, index: Column | int = 0) -> Column:
    """A part of the list without its empty parts; an index outside is moved to the nearer end."""
    items = _items(text, separator)
    i = F.lit(index) if isinstance(index, int) else index
    return F.when(F.size(items) > 0, F.element_at(items, F.greatest(F.lit(1), F.least(i + 1, F.size(items))).cast("int"))).otherwise(F.lit(""))


def str_list_length(text: Column, separator: str) -> Column:
    return F.size(_items(text, separator))


def str_substring(text: Column, position: int, count: int) -> Column:
    return F.substring(text, position + 1, count)


def str_compare(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """-1, 0 or 1."""
    a, b = (a, b) if case_sensitive else (F.lower(a), F.lower(b))
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def str_contains(text: Column, part: Column, case_sensitive: bool = False) -> Column:
    text, part = (text, part) if case_sensitive else (F.lower(text), F.lower(part))
    return F.contains(text, part).cast("int")


def cond(value: Column, then: Column, other: Column) -> Column:
    """then for a number other than 0 or the words true and yes; other for 0, false and no."""
    word = F.lower(value)
    number = value.try_cast("double")
    return F.when(word.isin("true", "yes"), then).when(word.isin("false", "no"), other).when(number == 0, other).when(number.isNotNull(), then)


def predicate(column: Column, operator: str, values: list) -> Column:
    """A comparison term of the field calculator: =, ==, !=, <, >, <=, >=, in, !in, startsWith, endsWith, contains."""
    first = values[0]
    match operator:
        case "=" | "==":
            return column == first
        case "!=":
            return column != first
        case "<":
            return column < first
        case ">":
            return column > first
        case "<=":
            return column <= first
        case ">=":
            return column >= first
        case "in":
            return column.isin(values)
        case "!in":
            return ~column.isin(values)
        case "startsWith":
            return column.startswith(first)
        case "endsWith":
            return column.endswith(first)
        case "contains":
            return column.contains(first)
    raise ValueError(f"unknown operator {operator}")
