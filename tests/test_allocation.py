"""Programs with one bound over all features, against the dual of the linear program."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import allocation

ROWS = "feature long, option string, area double, gain double, use double"


def optimum(rows, sense, amount):
    """The dual's least value: convex in the multiplier, so it lies at a place where some feature changes its option."""
    by = {}
    for feature, _, area, gain, use in rows:
        by.setdefault(feature, (area, [(0.0, 0.0)]))[1].append((gain, use))
    places = {0.0}
    for _, points in by.values():
        places |= {(a[0] - b[0]) / (a[1] - b[1]) for a in points for b in points if a[1] != b[1]}
    sign = 1 if sense == "<=" else -1
    return min(sum(area * max(g - m * u for g, u in points) for area, points in by.values()) + m * amount for m in places if m * sign >= 0)


def check(rows, got, sense, amount):
    of = {(f, o): (area, gain, use) for f, o, area, gain, use in rows}
    total = used = 0.0
    own = {}
    for feature, option, value in got:
        area, gain, use = of[feature, option]
        own[feature] = own.get(feature, 0) + value
        assert 0 < value and own[feature] <= area * (1 + 1e-12)
        total, used = total + gain * value, used + use * value
    assert used <= amount + 1e-6 if sense == "<=" else used >= amount - 1e-6
    assert total == pytest.approx(optimum(rows, sense, amount), rel=1e-9, abs=1e-6)


def program(rng, n, whole):
    rows = []
    for f in range(n):
        area = float(rng.randrange(1, 20))
        for o in rng.sample("abcdef", rng.randrange(1, 6)):
            draw = (lambda lo, hi: float(rng.randrange(lo, hi))) if whole else (lambda lo, hi: rng.uniform(lo, hi))
            rows.append((f, o, area, draw(-2, 6), draw(0, 5)))
    return rows


@pytest.mark.parametrize("whole", [True, False])
def test_bounds_against_the_dual(spark, whole):
    rng = random.Random(whole)
    rows = program(rng, 120, whole)
    df = spark.createDataFrame(rows, ROWS)
    most = {}
    for f, _, area, _, use in rows:
        most[f] = max(most.get(f, 0), use * area)
    for sense, share in (("<=", 0.0), ("<=", 0.2), ("<=", 5.0), (">=", 0.0), (">=", 0.9), (">=", 1.0)):
        amount = share * sum(most.values())
        got = [tuple(r) for r in allocation.solved_with_bound(df, F.col("gain"), F.col("use"), sense, amount, parts=7).select("feature", "option", "value").collect()]
        check(rows, got, sense, amount)
        assert sum(n > 1 for n in _pieces(got).values()) <= 1


def _pieces(got):
    out = {}
    for f, _, _ in got:
        out[f] = out.get(f, 0) + 1
    return out


def test_ties_and_odd_rows(spark):
    # All steps tie: they are taken by feature, and one is split.
    rows = [(f, "a", 2.0, 1.0, 1.0) for f in range(50)]
    got = sorted(tuple(r) for r in allocation.solved_with_bound(spark.createDataFrame(rows, ROWS), F.col("gain"), F.col("use"), "<=", 31.0, parts=4).select("feature", "option", "value").collect())
    assert got == [(f, "a", 2.0) for f in range(15)] + [(15, "a", 1.0)]
    odd = [(1, "a", 1.0, None, 1.0), (1, "b", 1.0, 3.0, None), (2, "a", 1.0, 2.0, 0.0), (2, "b", 1.0, 2.0, 0.0), (3, "a", 5.0, -1.0, 2.0)]
    df = spark.createDataFrame(odd, ROWS)
    assert [tuple(r) for r in allocation.solved_with_bound(df, F.col("gain"), F.col("use"), "<=", 1.0).select("feature", "option", "value").collect()] == [(2, "a", 1.0)]
    with pytest.raises(allocation.Infeasible):
        allocation.solved_with_bound(df, F.col("gain"), F.col("use"), ">=", 11.0)
    with pytest.raises(allocation.Infeasible):
        allocation.solved_with_bound(spark.createDataFrame([(1, "a", 1.0, 1.0, 1.0)], ROWS), F.col("gain"), F.col("use"), "<=", -1.0)
    assert allocation.solved_with_bound(df.limit(0), F.col("gain"), F.col("use"), "<=", 1.0).count() == 0


def test_negative_uses(spark):
    rng = random.Random(5)
    rows = [(f, o, a, g, u - 2) for f, o, a, g, u in program(rng, 60, False)]
    df = spark.createDataFrame(rows, ROWS)
    for sense, amount in (("<=", -100.0), ("<=", 50.0), (">=", 100.0), (">=", -50.0)):
        got = [tuple(r) for r in allocation.solved_with_bound(df, F.col("gain"), F.col("use"), sense, amount, parts=3).select("feature", "option", "value").collect()]
        check(rows, got, sense, amount)


def test_first_record_of_a_set(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 1.0, 1.0), (2, "a", 1.0, 1.0, 1.0)], ROWS).withColumn("variable", F.lit("v"))
    group = spark.createDataFrame([(2, 7, 1.0), (1, 7, 5.0)], "feature long, set int, bound double")
    assert allocation.grouped_constraints(rows, group, ["a"], "<=", "bound", "s")[1].first().rhs == 1.0
    assert allocation.grouped_constraints(rows, group, ["a"], "<=", "bound", "s", record="feature")[1].first().rhs == 5.0
