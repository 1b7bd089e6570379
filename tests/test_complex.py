"""Complex expressions against Python's own complex numbers."""

import cmath

import pytest
from pyspark.sql import functions as F

from rasterloom.functions.complex import compiled_complex, pair, real
from rasterloom.functions.expressions import ExpressionError

VALUES = [complex(a, b) for a in (-2.5, -1.0, -0.3, 0.0, 0.4, 1.0, 3.0) for b in (-1.7, 0.0, 0.6, 2.0)]
CASES = {
    **{f"{n}(z)": getattr(cmath, n) for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "asin", "acos", "atan", "asinh", "acosh", "atanh", "exp", "sqrt", "log10")},
    "ln(z)": cmath.log,
    "log(z)": cmath.log,
    "log2(z)": lambda z: cmath.log(z) / cmath.log(2),
    "real(z) + 2i * imag(z)": lambda z: z.real + 2j * z.imag,
    "conj(z)": lambda z: z.conjugate(),
    "arg(z)": cmath.phase,
    "norm(z)": lambda z: abs(z) ** 2,
    "abs(z)": abs,
    "z ^ 2 - (1 + 2i) / (z - 7i)": lambda z: z**2 - (1 + 2j) / (z - 7j),
    # Python refuses powers of 0 here; of a positive real part they are 0.
    "pow(z, 1 - i)": lambda z: z ** (1 - 1j) if z else 0,
    "-z * i + pi": lambda z: -z * 1j + cmath.pi,
    "w * z == z * w": lambda z: 1.0,
    "exp(i * pi * w) != z": lambda z: float(cmath.exp(1j * cmath.pi * 0.5) != z),
    "2 ^ -z": lambda z: 2 ** -z,
}


@pytest.mark.parametrize("text", CASES)
def test_against_cmath(spark, text):
    df = spark.createDataFrame([(k, z.real, z.imag) for k, z in enumerate(VALUES)], "k int, a double, b double")
    got = df.select("k", compiled_complex(text, {"z": pair(F.col("a"), F.col("b")), "w": real(F.lit(0.5))}).alias("v")).collect()
    for r in got:
        z = VALUES[r.k]
        try:
            want = complex(CASES[text](z))
        except (ValueError, ZeroDivisionError, OverflowError):
            assert r.v is None, (z, r.v)
            continue
        name = text.partition("(")[0]
        if name in ("asin", "acos", "acosh", "atanh") and z.imag == 0 and abs(z.real) > 1 or name in ("atan", "asinh") and z.real == 0 and abs(z.imag) > 1:
            # On a cut: either side's value.
            assert abs(abs(r.v.re) - abs(want.real)) < 1e-9 and abs(abs(r.v.im) - abs(want.imag)) < 1e-9
            continue
        assert r.v is not None and abs(complex(r.v.re, r.v.im) - want) < 1e-9 * max(1, abs(want)), (z, r.v, want)


def test_nulls_errors_and_plan_size(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 0.0)], "a double, b double")
    z = {"z": pair(F.col("a"), F.col("b"))}
    assert [r.v for r in df.select(compiled_complex("z * 2 + 1", z).alias("v")).collect()] == [None] * 3
    for bad in ("z < 1", "z !", "nope(z)", "q", "z +", "(z", "z ? 1 : 2"):
        with pytest.raises(ExpressionError):
            compiled_complex(bad, z)
    size = lambda n: len(df.select(compiled_complex(" * ".join(["(z + 1)"] * n), z).alias("v"))._jdf.queryExecution().optimizedPlan().toString())
    assert size(16) < 2.5 * size(8)
