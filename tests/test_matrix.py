"""Matrix expressions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.expressions import ExpressionError
from rasterloom.functions.matrix import compiled_matrix, matrix, number, vector

M, N, V, U, S = np.array([[1.5, 2, 3], [4, 5, 6], [7, 8, -9]]), np.array([[2.0, 0, 1], [1, 1, 1]]), np.array([[1.0], [2], [3]]), np.array([[4.0], [3], [2]]), 2.5
CASES = {
    "m": M, "m * m": M @ M, "n * m": N @ M, "m + m * 2 - eye(3)": M * 3 - np.eye(3), "10 * m / s": 10 * M / S, "m * v": M @ V, "v' * u": (V.T @ U)[0, 0], "2 * v' * u": 2 * (V.T @ U)[0, 0],
    "v * u'": V @ U.T, "n'": N.T, "(n')[2, 1]": N[1, 2], "v[1]": 2.0, "v'[2]": 3.0, "v'[0, 2]": 3.0, "m[s - 0.5, 0]": M[2, 0], "{1, 2, s}'": np.array([[1], [2], [S]]), "{{1, 2}, {s, 4}} * {1, 1}'": np.array([[3], [S + 4]]),
    "ones(1)": 1.0, "ones(2, 3)": np.ones((2, 3)), "zeros(3)": np.zeros((3, 3)), "eye(2, 3)": np.eye(2, 3), "size(eye(3, 6))": np.array([[3, 6]]), "size(n')": np.array([[3, 2]]), "size(s)": np.array([[1, 1]]),
    "-m": -M, "sum(m)": M.sum(), "max(m) - min(m) + sqrt(s) ^ 2": 17 + S, "(m * m')[0, 1] * s": (M @ M.T)[0, 1] * S, "m' * n' + ones(3, 2)": M.T @ N.T + 1, "m * m * m * m": M @ M @ M @ M,
}


@pytest.fixture(scope="module")
def known(spark):
    df = spark.createDataFrame([(M.tolist(), N.tolist(), V[:, 0].tolist(), U[:, 0].tolist(), S)], "m array<array<double>>, n array<array<double>>, v array<double>, u array<double>, s double")
    return df, {"m": matrix(F.col("m"), 3, 3), "n": matrix(F.col("n"), 2, 3), "v": vector(F.col("v"), 3), "u": vector(F.col("u"), 3), "s": number(F.col("s"))}


def test_against_numpy(known):
    df, names = known
    found = {k: compiled_matrix(k, names) for k in CASES}
    row = df.select(*(v.column.alias(f"c{k}") for k, v in enumerate(found.values()))).first()
    for (text, value), got in zip(found.items(), row, strict=True):
        want = np.asarray(CASES[text], float)
        assert (value.rows, value.columns) == (want.shape if want.ndim else (0, 0)), text
        assert np.allclose(np.asarray(got, float), want), (text, got)


def test_errors_and_plan_size(known):
    df, names = known
    for bad in ("v + m", "m - v", "v * m", "v + eye(2)", "0 - eye()", "m[1]", "m[1, 2, 3]", "v[1, 2]", "s + m", "m + s", "s / m", "m ^ 2", "ones(s)", "ones(0)", "{1, {2, 3}}", "{{1}, {2, 3}}", "s[0]", "m[3, 0]", "sin(m)", "nope(s)", "q", "m *", "'"):
        with pytest.raises(ExpressionError):
            compiled_matrix(bad, names)
    size = lambda n: len(df.select(compiled_matrix(" * ".join(["m"] * n), names).column.alias("c"))._jdf.queryExecution().optimizedPlan().toString())
    assert size(16) < 2.5 * size(8)
