"""Kernel scripts against the same scripts in plain Python."""

import random

import pytest

from rasterloom.functions.expressions import ExpressionError
from rasterloom.operators import focal
from rasterloom.sources.grids import GridSpec

W, H = 9, 7


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(1)
    values = {(x, y): round(rng.uniform(1, 9), 2) for x in range(W) for y in range(H)}
    return values, spark.createDataFrame([(x, y, v) for (x, y), v in values.items()], "x int, y int, value double")


def window(values, x, y, r):
    clip = lambda v, n: min(max(v, 0), n - 1)
    return [values[clip(x + dx, W), clip(y + dy, H)] for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def run(df, script, output, radius=1):
    return {(r.x, r.y): r[output] for r in focal.kernel_script(df, GridSpec(W, H), radius, ["value"], script, output).collect()}


def test_loops(cells):
    values, df = cells
    got = run(df, ["t = 1", "for k < numPix: t = t / 2 + kwinVal(value, k) / t", "t -= 1"], "t")
    for (x, y), v in got.items():
        t = 1.0
        for c in window(values, x, y, 1):
            t = t / 2 + c / t
        assert v == pytest.approx(t - 1)


def test_blocks_and_loops_within_loops(cells):
    values, df = cells
    script = "n = 0; s = 0; for i < numPix: { a = kwinVal(value, i); for j < i: { s += a > kwinVal(value, j); n += 1 }; last = a * 2 }; out = s * 1000 + n + last / 1000"
    got = run(df, script, "out")
    for (x, y), v in got.items():
        w = window(values, x, y, 1)
        s = sum(w[i] > w[j] for i in range(9) for j in range(i))
        assert v == pytest.approx(s * 1000 + 36 + w[8] * 2 / 1000)


def test_ends_and_names(cells):
    values, df = cells
    assert set(run(df, ["a = 3", "for k < a - 3: a += 100", "for k < a / 2: a += 1"], "a").values()) == {4.0}
    assert set(run(df, "for k < 4: b = k", "b").values()) == {3.0}
    assert set(run(df, "for k < 0: b = k", "b").values()) == {None}
    assert set(run(df, "q = 0; for k < 3: q = q * 10 + k + 1", "q").values()) == {123.0}
    for bad in ("b += 1", "for k < 3", "x y", "for k < 2: { a = 1", "a = 1 }", "for k < 3: k = 2"):
        with pytest.raises(ExpressionError):
            run(df, bad, "b")


def test_sums_over_the_window(cells):
    values, df = cells
    got = run(df, {"s": "kwinVal(value, {i}) * neigDist({i})", "out": "s + s"}, "out", 2)
    for (x, y), v in got.items():
        w = window(values, x, y, 2)
        assert v == pytest.approx(2 * sum(c * ((i % 5 - 2) ** 2 + (i // 5 - 2) ** 2) ** 0.5 for i, c in enumerate(w)))


def test_plan_keeps_its_size(cells):
    _, df = cells
    size = lambda n, r: len(focal.kernel_script(df, GridSpec(W, H), r, ["value"], ["t = 1", f"for k < {n}: t = t / 2 + kwinVal(value, k) / t"], "t")._jdf.queryExecution().optimizedPlan().toString())
    assert size(49, 3) <= size(4, 3) + 10
    many = ["t = 1", *["t = t / 2 + kwinVal(value, 0) / t"] * 12]
    few = many[:7]
    plan = lambda s: len(focal.kernel_script(df, GridSpec(W, H), 1, ["value"], s, "t")._jdf.queryExecution().optimizedPlan().toString())
    # Twice the statements, no more than some three times the plan.
    assert plan(many) < 3.5 * plan(few)
