"""As-of joins against plain Python; indexed tables by their plans."""

import os
import random
import urllib.parse

import pytest

from rasterloom.operators.asof import asof_joined
from rasterloom.sources.stored import NotUnique, indexed_table


def plain(left, right, forward, inclusive, how):
    out = []
    for k, t, v in left:
        fits = [] if k is None or t is None else [(u, w) for j, u, w in right if j == k and u is not None and ((u > t) if forward else (u < t) or (u == t and inclusive)) or (j == k and u == t and inclusive)]
        if fits:
            out.append((k, t, v, (min(fits) if forward else max(fits))[1]))
        elif how == "left":
            out.append((k, t, v, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, parts, forward):
    rng = random.Random(parts)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None, rng.randrange(4, 30)])
    left = [(key(), rng.choice([None, *range(60)]), v) for v in range(300)]
    left += left[:20]
    right = [(key(), rng.choice([None, *range(60)]), w) for w in range(120)] + [(9, 5, 1000), (9, 5, 1001)]
    a = spark.createDataFrame(left, "key int, t int, v int")
    b = spark.createDataFrame(right, "key int, u int, w int")
    for inclusive in (True, False):
        for how in ("left", "inner"):
            got = asof_joined(a, b, "key", "t", ["w"], right_at="u", forward=forward, inclusive=inclusive, how=how, parts=parts)
            assert sorted(map(tuple, got.collect()), key=str) == plain(left, right, forward, inclusive, how)
    assert asof_joined(a, b.limit(0), "key", "t", ["w"], right_at="u").where("w IS NOT NULL").count() == 0
    assert asof_joined(a.limit(0), b, "key", "t", ["w"], right_at="u").count() == 0


def test_indexed_tables(spark):
    rows = spark.createDataFrame([(k % 50, k, f"v{k}") for k in range(400)] + [(None, 7, "n"), (None, 7, "n")], "k int, n int, v string")
    own = indexed_table(rows, ["k"], 6)
    assert sorted(map(str, own.collect())) == sorted(map(str, rows.collect()))
    assert own.where("k = 3").count() == 8
    other = indexed_table(rows.select("k").distinct(), ["k"], 6, unique=True)
    joined = own.hint("merge").join(other, "k").groupBy("k").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50
    # A look-up opens one bucket's file: the others may be gone.
    used = {r.f for r in own.where("k = 3").selectExpr("input_file_name() AS f").collect()}
    assert len(used) == 1
    for f in own.inputFiles():
        if f not in used:
            os.remove(urllib.parse.urlparse(f).path)
    assert sorted(r.n for r in own.where("k = 3").collect()) == list(range(3, 400, 50))
    with pytest.raises(NotUnique):
        indexed_table(rows, ["k"], 6, unique=True)
    assert indexed_table(rows, ["k", "n"], 2, unique=True).count() == 402
