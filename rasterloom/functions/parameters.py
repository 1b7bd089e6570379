"""Parameter expressions: text with $[...]$ parts that are replaced by settings, table values and function results.

Runs on the driver, over single values; table cells are looked up with one small query each.
"""

from __future__ import annotations

import ast
import math
import operator
import os
import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Replacements made in one text, at most; a text that needs more refers to itself.
LIMIT = 15_000
INNERMOST = re.compile(r"\$\[((?:(?!\$\[|\]\$).)*)\]\$", re.S)


_NAMES = {n: getattr(math, n) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sqrt", "exp", "log10", "log2", "floor", "ceil")} | {"log": math.log, "ln": math.log, "abs": abs, "min": min, "max": max, "rint": round, "fmod": math.fmod, "sum": lambda *a: sum(a), "avg": lambda *a: sum(a) / len(a)}
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: math.fmod}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def _value(node: ast.AST) -> float:
    match node:
        case ast.Constant(value=int() | float() as v):
            return float(v)
        case ast.Name(id="_pi" | "pi"):
            return math.pi
        case ast.Name(id="_e" | "e"):
            return math.e
        case ast.BinOp() if type(node.op) in _BINARY:
            return _BINARY[type(node.op)](_value(node.left), _value(node.right))
        case ast.UnaryOp(op=ast.USub()):
            return -_value(node.operand)
        case ast.UnaryOp(op=ast.UAdd()):
            return _value(node.operand)
        case ast.BoolOp():
            return float((all if isinstance(node.op, ast.And) else any)(_value(v) != 0 for v in node.values))
        case ast.Compare(ops=[op], comparators=[right]) if type(op) in _COMPARE:
            return float(_COMPARE[type(op)](_value(node.left), _value(right)))
        case ast.IfExp():
            return _value(node.body if _value(node.test) else node.orelse)
        case ast.Call(func=ast.Name(id=name), keywords=[]) if name in _NAMES:
            return float(_NAMES[name](*map(_value, node.args)))
    raise ValueError(f"not arithmetic: {ast.dump(node)}")


def arithmetic(text: str) -> str:
    """The value of an arithmetic expression with 15 significant digits; whole numbers without a point. Operators: + - * / % ^, comparisons, && and ||, and c ? a : b."""
    code = _choices(text.replace("&&", " and ").replace("||", " or ").replace("^", "**"))
    return f"{_value(ast.parse(code.strip(), mode='eval').body):.15g}"


def _choices(code: str) -> str:
    """c ? a : b written as Python has it, also within parentheses."""
    depth = nested = 0
    ask = None
    for k, c in enumerate(code):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == ",":
            return f"{_choices(code[:k])},{_choices(code[k + 1 :])}"
        if depth == 0 and c == "?":
            ask, nested = (k, 0) if ask is None else (ask, nested + 1)
        elif depth == 0 and c == ":" and ask is not None:
            if not nested:
                return f"(({_choices(code[ask + 1 : k])}) if ({_choices(code[:ask])}) else ({_choices(code[k + 1 :])}))"
            nested -= 1
    out, begin = "", None
    for k, c in enumerate(code):
        if c == "(" and depth == 0:
            begin = k
        depth += (c == "(") - (c == ")")
        if begin is None:
            out += c
        elif depth == 0:
            out += f"({_choices(code[begin + 1 : k])})"
            begin = None
    return out


def _truth(text: str) -> bool | None:
    word = text.strip().lower()
    if word in ("true", "yes"):
        return True
    if word in ("false", "no"):
        return False
    try:
        return float(word) != 0
    except ValueError:
        return None


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _item(text: str, separator: str, index: str = "0") -> str:
    parts = [p for p in text.split(separator) if p]
    return parts[max(0, min(int(index), len(parts) - 1))] if parts else ""


def _compare(a: str, b: str, case: str = "0") -> str:
    if not _truth(case):
        a, b = a.lower(), b.lower()
    return str((a > b) - (a < b))


def _contains(a: str, b: str, case: str = "0") -> str:
    return str(int(b in a if _truth(case) else b.lower() in a.lower()))


def _cond(test: str, then: str, other: str) -> str:
    known = _truth(test)
    if known is None:
        known = float(arithmetic(test)) != 0
    return then if known else other


def _status(path: str):
    """A path's state as Spark's file systems tell it, so that stores only Spark reaches are seen; None if there is nothing. Without a session the local disk is asked."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return (os.path.isdir(path), int(os.path.getmtime(path) * 1000)) if os.path.exists(path) else None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = fs.getFileStatus(at)
    return found.isDirectory(), found.getModificationTime()


def _is(path: str, directory: bool) -> str:
    found = _status(path) if path else None
    return str(int(found is not None and found[0] == directory))


def _newer(a: str, b: str) -> str:
    """Whether the first file changed after the second; a file that isn't there is older than any."""
    times = [-1 if found is None else found[1] for found in map(_status, (a, b))]
    return str(int(times[0] > times[1]))


FUNCTIONS: dict[str, Callable[..., str]] = {
    "cond": _cond,
    "isFile": lambda p: _is(p, False),
    "isDir": lambda p: _is(p, True),
    "fileBaseName": lambda p: _name(p).split(".", 1)[0],
    "fileCompleteBaseName": lambda p: _name(p).rsplit(".", 1)[0],
    "filePath": lambda p: p.rsplit("/", 1)[0] if "/" in p else ".",
    "fileSuffix": lambda p: _name(p).rsplit(".", 1)[1] if "." in _name(p) else "",
    "fileCompleteSuffix": lambda p: _name(p).split(".", 1)[1] if "." in _name(p) else "",
    "fileOneIsNewer": _newer,
    "strReplace": lambda s, *ab: s.replace(*ab[:2]) if len(ab) > 1 else s,
    "strIsEmpty": lambda s="": str(int(not s)),
    "strLength": lambda s="": str(len(s)),
    "strListItem": _item,
    "strListLength": lambda s, sep="": str(len([p for p in s.split(sep) if p]) if sep else 1),
    "strSubstring": lambda s, at, n="-1": s[int(at) :] if int(n) < 0 else s[int(at) : int(at) + int(n)],
    "strCompare": _compare,
    "strContains": _contains,
}


def table_value(df: DataFrame, column: str, row: str, key: str | None = None) -> str:
    """A cell of a table, by the 1-based number of its row in the key's order; or the properties rowcount and columncount."""
    if column == "rowcount":
        return str(df.count())
    if column == "columncount":
        return str(len(df.columns))
    if int(row) < 1:
        return ""
    # The rows up to the wanted one are a limit of the plan: each task sends that many at most.
    found = df.orderBy(key or df.columns[0]).select(column).offset(int(row) - 1).limit(1).first()
    return "" if found is None or found[0] is None else str(found[0])


def resolved(text: str, settings: Mapping[str, str] | None = None, tables: Mapping[str, DataFrame] | None = None, steps: Mapping[str, int] | None = None, properties: Mapping[str, Mapping[str, list]] | None = None) -> str:
    """The text with each $[...]$ replaced, innermost first.

    func:name(args) calls a function, math:expression calculates, setting:key looks up a setting (empty if
    unknown), name:column:row a table's cell, name:property:index an entry of a component's list, name
    the component's iteration step. An index may be given as idx+n or idx-n, from the step.
    """
    settings, tables, steps, properties = settings or {}, tables or {}, steps or {}, properties or {}

    def one(inner: str) -> str:
        kind, _, rest = inner.partition(":")
        if kind == "func":
            name, _, args = rest.partition("(")
            if name == "hasAttribute":
                table, column = (a.strip().strip('"') for a in args.rstrip(")").split(","))
                return str(int(table in tables and column in tables[table].columns))
            return FUNCTIONS[name](*(a.strip().strip('"') for a in args.rsplit(")", 1)[0].split(",")))
        if kind == "math":
            return arithmetic(rest)
        if kind == "setting":
            return settings.get(rest, "")
        if not rest and kind in steps:
            return str(steps[kind])
        part, _, place = rest.partition(":")
        moved = re.fullmatch(r"idx([+-]\d+)?", place)
        if moved:
            place = str(steps.get(kind, 1) + int(moved[1] or 0))
        if kind in tables:
            return table_value(tables[kind], part, place)
        if kind in properties:
            values = properties[kind].get(part, [])
            return str(values[max(0, min(int(place or 1) - 1, len(values) - 1))]) if values else ""
        raise ValueError(f"unknown name in $[{inner}]$")

    for _ in range(LIMIT):
        m = INNERMOST.search(text)
        if m is None:
            return text
        text = text[: m.start()] + one(m[1]) + text[m.end() :]
    raise ValueError("more replacements than the limit: the text refers to itself")


def step_index(policy: str, step: int, n: int, host_step: int | None = None) -> int:
    """Which of n values a step (from 1) takes: use_up repeats the last, cycle begins again, sync follows the host's step."""
    if policy == "cycle":
        return (step - 1) % n
    return min((host_step if policy == "sync" and host_step is not None else step) - 1, n - 1)
