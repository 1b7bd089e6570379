"""Expressions of matrices as Spark columns.

Shapes are known when an expression is compiled, so a mismatch is an error before anything runs; values are arrays of
rows. Operands are bound before they are used, so a product of products keeps a plan of the size of its text.
A matrix of one element is a number, as the product of a row and a column is. Indices count from 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.complex import _bound
from rasterloom.functions.expressions import CONSTANTS, FUNCTIONS, SIGN, ExpressionError, _number, _Reader

TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>[-+*/^(),{}\[\]']))")


@dataclass(frozen=True)
class Value:
    """A number (no rows) or a matrix, and, of a number that the text itself gives, that number."""

    column: Column
    rows: int = 0
    columns: int = 0
    known: float | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.columns


def number(column: Column) -> Value:
    return Value(column.cast("double"))


def matrix(column: Column, rows: int, columns: int) -> Value:
    """An array of `rows` arrays of `columns` numbers each."""
    return Value(column.cast("array<array<double>>"), rows, columns)


def vector(column: Column, size: int) -> Value:
    """An array of numbers as a matrix of one column."""
    return Value(F.transform(column.cast("array<double>"), lambda v: F.array(v)), size, 1)


def _shaped(column: Column, rows: int, columns: int) -> Value:
    return Value(F.get(F.get(column, F.lit(0)), F.lit(0))) if rows == columns == 1 else Value(column, rows, columns)


def _each(m: Value, f: Callable[[Column], Column]) -> Value:
    return Value(F.transform(m.column, lambda row: F.transform(row, f)), m.rows, m.columns)


def _scaled(m: Value, s: Value, f: Callable[[Column, Column], Column]) -> Value:
    scaled = lambda k: F.transform(m.column, lambda row: F.transform(row, lambda v: f(v, k)))
    return Value(_bound(s.column, scaled), m.rows, m.columns)


def transposed(m: Value) -> Value:
    if not m.rows:
        return m
    turned = lambda a: F.transform(F.sequence(F.lit(0), F.lit(m.columns - 1)), lambda j: F.transform(a, lambda row: F.get(row, j)))
    return Value(_bound(m.column, turned), m.columns, m.rows)


def product(a: Value, b: Value) -> Value:
    if a.columns != b.rows:
        raise ExpressionError(f"no product of matrices of {a.shape} and {b.shape}")

    def cell(row: Column, right: Column, j: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(a.columns - 1)), F.lit(0.0), lambda s, t: s + F.get(row, t) * F.get(F.get(right, t), j))

    def rows(left: Column, right: Column) -> Column:
        return F.transform(left, lambda row: F.transform(F.sequence(F.lit(0), F.lit(b.columns - 1)), lambda j: cell(row, right, j)))

    return _shaped(_bound(a.column, lambda left: _bound(b.column, lambda right: rows(left, right))), a.rows, b.columns)


def _filled(rows: float, columns: float, value: Callable[[int, int], float]) -> Value:
    n, m = int(rows), int(columns)
    if n < 1 or m < 1 or n != rows or m != columns:
        raise ExpressionError(f"no matrix of {rows} rows and {columns} columns")
    return _shaped(F.array(*(F.array(*(F.lit(float(value(i, j))) for j in range(m))) for i in range(n))), n, m)


#: Matrices of given sizes; with one size they are square.
MADE: dict[str, Callable[[int, int], float]] = {"ones": lambda i, j: 1, "zeros": lambda i, j: 0, "eye": lambda i, j: i == j}
#: Of all elements of a matrix.
TOTALS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v),
    "min": F.array_min,
    "max": F.array_max,
}


class _MatrixReader(_Reader):
    def __init__(self, text: str, variables: Mapping[str, Value]):
        self.variables, self.at, self.tokens, place = variables, 0, [], 0
        while text[place:].strip():
            m = TOKEN.match(text, place)
            if not m:
                raise ExpressionError(f"unexpected text at {place}: {text[place : place + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            place = m.end()

    def choice(self) -> Value:
        return self.binary(0)

    def apply(self, op: str, a: Value, b: Value) -> Value:
        if op in "+-":
            f = (lambda x, y: x + y) if op == "+" else (lambda x, y: x - y)
            if a.shape != b.shape:
                raise ExpressionError(f"no {'sum' if op == '+' else 'difference'} of shapes {a.shape} and {b.shape}")
            if not a.rows:
                return Value(f(a.column, b.column))
            return Value(F.zip_with(a.column, b.column, lambda p, q: F.zip_with(p, q, f)), a.rows, a.columns)
        if op == "*":
            if a.rows and b.rows:
                return product(a, b)
            if a.rows or b.rows:
                return _scaled(a, b, lambda v, k: v * k) if a.rows else _scaled(b, a, lambda v, k: v * k)
            return Value(a.column * b.column)
        if b.rows or op == "^" and a.rows:
            raise ExpressionError(f"no {op} of shapes {a.shape} and {b.shape}")
        if op == "/":
            return _scaled(a, b, F.try_divide) if a.rows else Value(F.try_divide(a.column, b.column))
        return Value(_number(F.pow(a.column, b.column)))

    def value(self) -> Value:
        out = self.plain()
        while self.peek() in ("'", "["):
            if self.take()[1] == "'":
                out = transposed(out)
                continue
            places = self.listed("]")
            if not out.rows:
                raise ExpressionError("a number has no index")
            if len(places) == 1:
                if 1 not in out.shape:
                    raise ExpressionError(f"one index into a matrix of {out.shape}")
                places = [places[0], Value(F.lit(0.0), known=0.0)] if out.columns == 1 else [Value(F.lit(0.0), known=0.0), places[0]]
            if len(places) != 2 or any(p.rows for p in places):
                raise ExpressionError("an index is a row and a column")
            for p, n in zip(places, out.shape, strict=True):
                if p.known is not None and not 0 <= p.known < n:
                    raise ExpressionError(f"index {p.known:g} of {n}")
            i, j = (F.floor(p.column).cast("int") for p in places)
            out = Value(F.get(F.get(out.column, i), j))
        return out

    def listed(self, end: str) -> list[Value]:
        out = []
        while self.peek() != end:
            out.append(self.choice())
            if self.peek() != end:
                self.take(",")
        self.take(end)
        return out

    def plain(self) -> Value:
        kind, token = self.take()
        if kind == "number":
            return Value(F.lit(float(token)), known=float(token))
        if token == "(":
            inner = self.choice()
            self.take(")")
            return inner
        if token in ("+", "-"):
            inner = self.binary(SIGN)
            return inner if token == "+" else _each(inner, lambda v: -v) if inner.rows else Value(-inner.column, known=None if inner.known is None else -inner.known)
        if token == "{":
            parts = self.listed("}")
            if not parts or len({p.shape for p in parts}) > 1 or parts[0].rows > 1:
                raise ExpressionError("braces hold numbers, or rows of one length")
            if not parts[0].rows:
                return _shaped(F.array(F.array(*(p.column for p in parts))), 1, len(parts))
            return Value(F.array(*(F.get(p.column, F.lit(0)) for p in parts)), len(parts), parts[0].columns)
        if kind == "name" and self.peek() == "(":
            self.take("(")
            return self.called(token, self.listed(")"))
        if kind == "name":
            if token in self.variables:
                return self.variables[token]
            if token in CONSTANTS:
                return Value(F.lit(CONSTANTS[token]), known=CONSTANTS[token])
            raise ExpressionError(f"unknown name {token}")
        raise ExpressionError(f"unexpected {token}")

    def called(self, name: str, args: list[Value]) -> Value:
        if name in MADE:
            if len(args) not in (1, 2) or any(a.known is None for a in args):
                raise ExpressionError(f"{name} takes one or two given numbers")
            return _filled(args[0].known, args[-1].known, MADE[name])
        if name == "size":
            if len(args) != 1:
                raise ExpressionError("size takes one value")
            rows, columns = args[0].shape if args[0].rows else (1, 1)
            return Value(F.array(F.array(F.lit(float(rows)), F.lit(float(columns)))), 1, 2)
        if name in TOTALS and len(args) == 1 and args[0].rows:
            return Value(TOTALS[name](F.flatten(args[0].column)))
        if name not in FUNCTIONS or any(a.rows for a in args):
            raise ExpressionError(f"unknown function {name} of shapes {[a.shape for a in args]}")
        return Value(_number(FUNCTIONS[name](*(a.column for a in args)).cast("double")))


def compiled_matrix(text: str, variables: Mapping[str, Value]) -> Value:
    """The value that a matrix expression stands for: + - * / ^, ' (transposed), [row, column], {1, 2} and {{1, 2}, {3, 4}}, ones, zeros, eye, size, sum, min, max, and functions of numbers."""
    reader = _MatrixReader(text, variables)
    out = reader.choice()
    if reader.peek() is not None:
        raise ExpressionError(f"unexpected {reader.peek()}")
    return out
