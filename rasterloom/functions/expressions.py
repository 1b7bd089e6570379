"""Map-algebra expressions as Spark columns.

All values are doubles: comparisons and logic give 0 or 1, any value but 0 counts as true, and null (no
data) stays null. Division by zero and results outside a function's domain are null. The text becomes one
column expression, so it runs inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binding power of each binary operator; power binds tightest, and tighter than a sign.
POWER = {"||": 1, "or": 1, "&&": 2, "and": 2, "|": 3, "&": 3.5, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "<<": 4.5, ">>": 4.5, "+": 5, "-": 5, "*": 6, "/": 6, "^": 8}
SIGN = 7
TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:[nuµmkMG](?![A-Za-z_0-9]))?)|(?P<name>[A-Za-z_]\w*)|(?P<text>'[^']*')|(?P<op>\|\||&&|<<|>>|[<>=!]=|[-+*/^<>()?:,&|!]))")
#: Named constants.
CONSTANTS = {"_pi": 3.141592653589793, "_e": 2.718281828459045, "pi": 3.141592653589793, "e": 2.718281828459045, "log2e": 1.4426950408889634, "log10e": 0.4342944819032518, "ln2": 0.6931471805599453, "ln10": 2.302585092994046, "euler": 0.5772156649015329}


#: Factors of the letters that may follow a number.
UNITS = {"n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "k": 1e3, "M": 1e6, "G": 1e9}
#: Functions whose result is text.
TEXTUAL = ("toupper", "tolower", "concat")


class ExpressionError(ValueError):
    """Text that is not an expression."""


def _flag(c: Column) -> Column:
    return c.cast("double")


def _true(c: Column) -> Column:
    return c != F.lit(0.0)


def _number(c: Column) -> Column:
    """Not-a-number and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def _whole(f: Callable[..., Column], *a: Column) -> Column:
    """f over all of its arguments; null if one of them is."""
    return F.when(reduce(lambda x, y: x | y, (c.isNull() for c in a)), F.lit(None)).otherwise(f(*a) if len(a) > 1 else a[0])


def _choice(c: Column, a: Column, b: Column) -> Column:
    return F.when(c.isNull(), F.lit(None).cast("double")).when(_true(c), a).otherwise(b)


def _ndvi(red: Column, infrared: Column) -> Column:
    return F.when(F.abs(red + infrared) < 1e-6, F.lit(0.0)).otherwise(F.try_divide(infrared - red, infrared + red))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{n: getattr(F, n) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "exp", "sqrt", "rint", "abs", "floor", "ceil")},
    "atan2": F.atan2,
    "log2": F.log2,
    "log10": F.log10,
    "log": F.ln,
    "ln": F.ln,
    "sign": F.signum,
    "pow": F.pow,
    "fmod": lambda a, b: F.when(b == 0, F.lit(None)).otherwise(a % F.when(b != 0, b)),
    "mod": lambda a, b: F.when(b == 0, F.lit(None)).otherwise(a % F.when(b != 0, b)),
    "sum": lambda *a: reduce(lambda x, y: x + y, a),
    "avg": lambda *a: reduce(lambda x, y: x + y, a) / F.lit(float(len(a))),
    "min": lambda *a: _whole(F.least, *a),
    "max": lambda *a: _whole(F.greatest, *a),
    "sizeof": lambda *a: F.lit(float(len(a))),
    "strlen": lambda s: F.length(s.cast("string")),
    "str2dbl": lambda s: s.cast("string").try_cast("double"),
    "toupper": lambda s: F.upper(s.cast("string")),
    "tolower": lambda s: F.lower(s.cast("string")),
    "concat": lambda *a: F.concat(*(x.cast("string") for x in a)),
    "if": _choice,
    "ndvi": _ndvi,
    "NDVI": _ndvi,
}


class _Reader:
    """Reads an expression by the binding powers of its operators."""

    def __init__(self, text: str, variables: Mapping[str, Column], functions: Mapping[str, Callable[..., Column]]):
        self.variables, self.functions, self.at = variables, functions, 0
        self.tokens: list[tuple[str, str]] = []
        place = 0
        while text[place:].strip():
            m = TOKEN.match(text, place)
            if not m:
                raise ExpressionError(f"unexpected text at {place}: {text[place : place + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            place = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted not in (None, self.tokens[self.at][1]):
            raise ExpressionError(f"expected {wanted or 'a value'}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def choice(self) -> Column:
        c = self.binary(0)
        if self.peek() == "?":
            self.take("?")
            a = self.choice()
            self.take(":")
            return _choice(c, a, self.choice())
        return c

    def binary(self, least: int) -> Column:
        left = self.value()
        while (op := self.peek()) in POWER and POWER[op] > least:
            self.take()
            right = self.binary(POWER[op] - (op == "^"))
            left = self.apply(op, left, right)
        return left

    def apply(self, op: str, a: Column, b: Column) -> Column:
        match op:
            case "+":
                return a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return F.try_divide(a, b)
            case "^":
                return _number(F.pow(a, b))
            case "&&" | "and":
                return _flag(_true(a) & _true(b))
            case "||" | "or":
                return _flag(_true(a) | _true(b))
            case "&" | "|" | "<<" | ">>":
                return INTEGER[{"&": "bitand", "|": "bitor", "<<": "shiftleft", ">>": "shiftright"}[op]](a, b).cast("double")
        return _flag({"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op])

    def value(self) -> Column:
        out = self.plain()
        while self.peek() == "!":
            self.take("!")
            out = INTEGER["factorial"](out).cast("double")
        return out

    def cast(self) -> str | None:
        """The kind of a cast that stands here: (int) or (float)."""
        names = [t for _, t in self.tokens[self.at : self.at + 2]]
        if len(names) == 2 and names[0] in ("int", "float") and names[1] == ")":
            self.at += 2
            return names[0]
        return None

    def plain(self) -> Column:
        kind, token = self.take()
        if kind == "number":
            return F.lit(float(token[:-1]) * UNITS[token[-1]] if token[-1] in UNITS else float(token))
        if kind == "text":
            return F.lit(token[1:-1])
        if token == "(" and (wanted := self.cast()):
            inner = self.binary(SIGN)
            # Towards zero, as a cast of a number goes.
            return F.when(inner < 0, F.ceil(inner)).otherwise(F.floor(inner)).cast("double") if wanted == "int" else inner
        if token == "(":
            inner = self.choice()
            self.take(")")
            return inner
        if token == "!":
            return _flag(~_true(self.binary(SIGN)))
        if token in "+-":
            inner = self.binary(SIGN)
            return -inner if token == "-" else inner
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
            out = self.functions[token](*args)
            return out if token in TEXTUAL else _number(out.cast("double"))
        if kind == "name":
            if token in self.variables:
                return self.variables[token]
            if token in CONSTANTS:
                return F.lit(CONSTANTS[token])
            raise ExpressionError(f"unknown name {token}")
        raise ExpressionError(f"unexpected {token}")


def compiled(text: str, variables: Mapping[str, Column], functions: Mapping[str, Callable[..., Column]] | None = None) -> Column:
    """The column that an expression over the named columns stands for."""
    reader = _Reader(text, variables, FUNCTIONS | dict(functions or {}))
    out = reader.choice()
    if reader.peek() is not None:
        raise ExpressionError(f"unexpected {reader.peek()}")
    return out


def split_list(text: str) -> list[str]:
    """Expressions separated by commas outside parentheses."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def drawn(seed: int, *keys: Column) -> Column:
    """A draw from [0, 1) that hangs on the seed and the keys alone: the first 52 bits of a digest, the same on every cluster."""
    digits = F.substring(F.md5(F.concat_ws(",", F.lit(str(seed)), *(k.cast("string") for k in keys))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def random_functions(seed: int, keys: tuple[str, ...] = ("x", "y")) -> dict[str, Callable[..., Column]]:
    """Random draws by hash of the seed and the cell, so that every cluster, and a rerun task, draws the same values."""
    one = lambda k=0: drawn(seed + k, *map(F.col, keys))
    normal = lambda: F.sqrt(-2 * F.ln(1 - one(1))) * F.cos(F.lit(2 * CONSTANTS["pi"]) * one(2))
    return {
        "rand": lambda lo, hi: lo + (hi - lo) * one(),
        "unifdist_real": lambda lo, hi: lo + (hi - lo) * one(),
        "unifdist_int": lambda lo, hi: F.floor(lo + (hi - lo + 1) * one()),
        "normdist": lambda m, s: m + s * normal(),
        "lndist": lambda m, s: F.exp(m + s * normal()),
    }


def integer_functions() -> dict[str, Callable[..., Column]]:
    """Functions of whole numbers: bits, shifts, factorial."""
    whole = lambda c: c.cast("long")
    return {
        "bitand": lambda a, b: whole(a).bitwiseAND(whole(b)),
        "bitor": lambda a, b: whole(a).bitwiseOR(whole(b)),
        "shiftleft": lambda a, b: whole(a) * F.pow(F.lit(2.0), b),
        "shiftright": lambda a, b: F.floor(a / F.pow(F.lit(2.0), b)),
        "factorial": lambda a: F.factorial(a.cast("int")),
    }


INTEGER = integer_functions()
