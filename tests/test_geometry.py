"""B-spline resampling against the splines' own linear system, solved whole."""

import math
import random

import numpy as np
import pytest

from rasterloom.operators import geometry
from rasterloom.sources.grids import GridSpec


def cox(order, t):
    """The centred B-spline by the recursion over orders."""
    if order == 0:
        return 1.0 if -0.5 <= t < 0.5 else 0.0
    h = (order + 1) / 2
    return ((h + t) * cox(order - 1, t + 0.5) + (h - t) * cox(order - 1, t - 0.5)) / order


def mirrored(k, n):
    while not 0 <= k < n:
        k = -k if k < 0 else 2 * (n - 1) - k
        if n == 1:
            return 0
    return k


def coefficients(values, order):
    """Solves for the coefficients whose spline goes through the values, along the first axis."""
    n = len(values)
    a = np.zeros((n, n))
    for i in range(n):
        for k in range(i - order, i + order + 1):
            a[i, mirrored(k, n)] += cox(order, i - k)
    return np.linalg.solve(a, values)


def plain(values, order, sx, sy):
    h, w = values.shape
    c = coefficients(coefficients(values, order).T, order).T
    out = {}
    for j, y in enumerate(sy):
        for i, x in enumerate(sx):
            if 0 <= x <= w - 1 and 0 <= y <= h - 1:
                near = lambda p: range(math.floor(p) - order, math.floor(p) + order + 2)
                out[i, j] = sum(cox(order, x - k) * cox(order, y - m) * c[mirrored(m, h), mirrored(k, w)] for m in near(y) for k in near(x))
            else:
                out[i, j] = None
    return out


def grid(spark, values):
    return spark.createDataFrame([(x, y, float(v)) for y, row in enumerate(values) for x, v in enumerate(row)], "x int, y int, value double")


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4, 5])
def test_splines_against_the_linear_system(spark, order):
    rng = np.random.default_rng(order)
    for h, w in ((23, 17), (3, 40), (2, 2)):
        values = rng.normal(100, 30, (h, w))
        source = GridSpec(w, h, (10.0, -4.0), (2.0, 0.5))
        target = GridSpec(9, 11, (9.3, -4.21), (w / 5, h / 20))
        sx = [(9.3 + i * w / 5 - 10) / 2 for i in range(9)]
        sy = [(-4.21 + j * h / 20 + 4) / 0.5 for j in range(11)]
        want = plain(values, order, sx, sy)
        got = {}
        for tile in (5, 8, 1024):
            got = {(r.x, r.y): r.value for r in geometry.resampled(grid(spark, values), source, target, "bspline", order=order, tile=tile).collect()}
            assert got.keys() == want.keys()
            for at, v in want.items():
                assert (got[at] is None) == (v is None) and (v is None or abs(got[at] - v) < 1e-9), (order, tile, at)


def test_a_spline_goes_through_its_cells_and_has_holes(spark):
    rng = random.Random(3)
    cells = [(x, y, None if (x, y) == (6, 5) else rng.random()) for x in range(12) for y in range(10) if (x, y) != (2, 2)]
    df = spark.createDataFrame(cells, "x int, y int, value double")
    spec = GridSpec(12, 10)
    got = {(r.x, r.y): r.value for r in geometry.resampled(df, spec, spec, "bspline", outside=-1.0).collect()}
    assert len(got) == 120
    near = {(x, y) for x in range(12) for y in range(10) if any(abs(x - a) <= 1 and abs(y - b) <= 1 for a, b in ((2, 2), (6, 5)))}
    # The cubic spline at a cell weighs that cell and its eight neighbours, and nothing beyond.
    assert {at for at, v in got.items() if v is None} == near
    target = GridSpec(2, 1, (-3.0, 0.0), (20.0, 1.0))
    assert {r.value for r in geometry.resampled(df, spec, target, "bspline", outside=-1.0).collect()} == {-1.0}
    with pytest.raises(ValueError):
        geometry.resampled(df, spec, spec, "bspline", order=6)


def test_poles():
    assert geometry.spline_poles(3) == [pytest.approx(math.sqrt(3) - 2)]
    assert geometry.spline_poles(2) == [pytest.approx(math.sqrt(8) - 3)]
    assert len(geometry.spline_poles(4)) == len(geometry.spline_poles(5)) == 2
