"""Expressions of complex numbers as Spark columns.

A value is a struct of two doubles, re and im. Every operation binds its operands first, so an operand is worked out
once and a plan has the size of the expression's text. Branches are the principal ones: cuts run along the negative
real axis for logarithm, root and power, along the real axis beyond -1 and 1 for asin, acos and atanh (acosh: below 1), and
along the imaginary axis beyond -i and i for atan and asinh. Null parts, division by zero and the logarithm of zero give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.expressions import CONSTANTS, ExpressionError, _Reader


def pair(re: Column, im: Column) -> Column:
    """The value of two parts; null if one is null, not a number or infinite."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(sound(re) & sound(im), F.struct(re.cast("double").alias("re"), im.cast("double").alias("im")))


def real(c: Column) -> Column:
    return pair(c.cast("double"), F.lit(0.0))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one(f: Callable[[Column, Column], tuple[Column, Column]]) -> Callable[[Column], Column]:
    """A function of a value's parts, as a function of the value."""
    return lambda z: _bound(z, lambda v: _parts(*f(v["re"], v["im"])))


def _two(f: Callable[[Column, Column, Column, Column], tuple[Column, Column]]) -> Callable[[Column, Column], Column]:
    return lambda a, b: _bound(a, lambda u: _bound(b, lambda v: _parts(*f(u["re"], u["im"], v["re"], v["im"]))))


def _parts(re: Column, im: Column) -> Column:
    return _bound(F.struct(re.cast("double").alias("re"), im.cast("double").alias("im")), lambda v: pair(v["re"], v["im"]))


add, subtract = _two(lambda a, b, c, d: (a + c, b + d)), _two(lambda a, b, c, d: (a - c, b - d))
multiply = _two(lambda a, b, c, d: (a * c - b * d, a * d + b * c))
divide = _two(lambda a, b, c, d: (F.try_divide(a * c + b * d, c * c + d * d), F.try_divide(b * c - a * d, c * c + d * d)))
negative, conj = _one(lambda x, y: (-x, -y)), _one(lambda x, y: (x, -y))
#: Times i, and times -i.
_turned, _turned_back = _one(lambda x, y: (-y, x)), _one(lambda x, y: (y, -x))
exp = _one(lambda x, y: (F.exp(x) * F.cos(y), F.exp(x) * F.sin(y)))
ln = _one(lambda x, y: (F.when((x != 0) | (y != 0), F.ln(F.hypot(x, y))), F.atan2(y, x)))
sin, cos = _one(lambda x, y: (F.sin(x) * F.cosh(y), F.cos(x) * F.sinh(y))), _one(lambda x, y: (F.cos(x) * F.cosh(y), -F.sin(x) * F.sinh(y)))
sinh, cosh = _one(lambda x, y: (F.sinh(x) * F.cos(y), F.cosh(x) * F.sin(y))), _one(lambda x, y: (F.cosh(x) * F.cos(y), F.sinh(x) * F.sin(y)))


def _root(x: Column, y: Column) -> tuple[Column, Column]:
    r = F.hypot(x, y)
    return F.sqrt(F.greatest(F.lit(0.0), (r + x) / 2)), F.when(y < 0, -F.sqrt(F.greatest(F.lit(0.0), (r - x) / 2))).otherwise(F.sqrt(F.greatest(F.lit(0.0), (r - x) / 2)))


sqrt = _one(_root)
_UNIT = lambda: real(F.lit(1.0))


def _half(z: Column) -> Column:
    return _one(lambda x, y: (x / 2, y / 2))(z)


def asin(z: Column) -> Column:
    return _bound(z, lambda v: _turned_back(ln(add(_turned(v), multiply(sqrt(subtract(_UNIT(), v)), sqrt(add(_UNIT(), v)))))))


def acos(z: Column) -> Column:
    return subtract(real(F.lit(math.pi / 2)), asin(z))


def atan(z: Column) -> Column:
    return _bound(z, lambda v: _turned(_half(subtract(ln(subtract(_UNIT(), _turned(v))), ln(add(_UNIT(), _turned(v)))))))


def asinh(z: Column) -> Column:
    return _turned_back(asin(_turned(z)))


def acosh(z: Column) -> Column:
    return _bound(z, lambda v: ln(add(v, multiply(sqrt(subtract(v, _UNIT())), sqrt(add(v, _UNIT()))))))


def atanh(z: Column) -> Column:
    return _bound(z, lambda v: _half(subtract(ln(add(_UNIT(), v)), ln(subtract(_UNIT(), v)))))


def power(a: Column, b: Column) -> Column:
    """a to b, by the logarithm; 0 to the 0 is 1, and 0 to what has a positive real part is 0."""

    def of(u: Column, v: Column) -> Column:
        zero = (u["re"] == 0) & (u["im"] == 0)
        none = (v["re"] == 0) & (v["im"] == 0)
        return F.when(zero & none, real(F.lit(1.0))).when(zero & (v["re"] > 0), real(F.lit(0.0))).otherwise(exp(multiply(v, ln(u))))

    return _bound(a, lambda u: _bound(b, lambda v: of(u, v)))


def _scaled(z: Column, by: float) -> Column:
    return _one(lambda x, y: (x * by, y * by))(z)


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "real": lambda z: real(z["re"]),
    "imag": lambda z: real(z["im"]),
    "conj": conj,
    "arg": _one(lambda x, y: (F.atan2(y, x), F.lit(0.0))),
    "norm": _one(lambda x, y: (x * x + y * y, F.lit(0.0))),
    "abs": _one(lambda x, y: (F.hypot(x, y), F.lit(0.0))),
    "sin": sin, "cos": cos, "tan": lambda z: _bound(z, lambda v: divide(sin(v), cos(v))),
    "sinh": sinh, "cosh": cosh, "tanh": lambda z: _bound(z, lambda v: divide(sinh(v), cosh(v))),
    "asin": asin, "acos": acos, "atan": atan, "asinh": asinh, "acosh": acosh, "atanh": atanh,
    "exp": exp, "ln": ln, "log": ln, "sqrt": sqrt, "pow": power,
    "log2": lambda z: _scaled(ln(z), CONSTANTS["log2e"]),
    "log10": lambda z: _scaled(ln(z), CONSTANTS["log10e"]),
}


class _ComplexReader(_Reader):
    """The grammar of map-algebra expressions over complex values: numbers may end in i, and i is the imaginary unit."""

    def apply(self, op: str, a: Column, b: Column) -> Column:
        plain = {"+": add, "-": subtract, "*": multiply, "/": divide, "^": power}
        if op in plain:
            return plain[op](a, b)
        if op in ("==", "!="):
            same = _bound(a, lambda u: _bound(b, lambda v: (u["re"] == v["re"]) & (u["im"] == v["im"])))
            return real((same if op == "==" else ~same).cast("double"))
        raise ExpressionError(f"complex numbers have no {op}")

    def value(self) -> Column:
        out = self.plain()
        if self.peek() == "!":
            raise ExpressionError("complex numbers have no factorial")
        return out

    def choice(self) -> Column:
        out = self.binary(0)
        if self.peek() == "?":
            raise ExpressionError("complex numbers have no conditions")
        return out

    def plain(self) -> Column:
        kind, token = self.take()
        if kind == "number":
            if self.peek() == "i":
                self.take()
                return pair(F.lit(0.0), F.lit(float(token)))
            return real(F.lit(float(token)))
        if token == "(":
            inner = self.choice()
            self.take(")")
            return inner
        if token in ("+", "-"):
            inner = self.binary(7)
            return negative(inner) if token == "-" else inner
        if kind == "name" and self.peek() == "(":
            if token not in self.functions:
                raise ExpressionError(f"unknown function {token}")
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.choice())
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            return self.functions[token](*args)
        if kind == "name":
            if token in self.variables:
                return self.variables[token]
            if token == "i":
                return pair(F.lit(0.0), F.lit(1.0))
            if token in CONSTANTS:
                return real(F.lit(CONSTANTS[token]))
            raise ExpressionError(f"unknown name {token}")
        raise ExpressionError(f"unexpected {token}")


def compiled_complex(text: str, variables: Mapping[str, Column]) -> Column:
    """The struct column (re, im) that a complex expression stands for. variables: names to columns, made by pair() or real()."""
    reader = _ComplexReader(text, variables, FUNCTIONS)
    out = reader.choice()
    if reader.peek() is not None:
        raise ExpressionError(f"unexpected {reader.peek()}")
    return out
