"""What SQL can't state, against plain Python on small grids; and empty tables, nulls and ties."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import attributes, combine, focal, geometry, overlay, sorting, spread, zonal
from rasterloom.sources import tables
from rasterloom.sources.grids import GridSpec, random_cells

SPEC = GridSpec(17, 13)


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(1)
    rows = [(x, y, float(rng.randint(0, 30)) if (x, y) != (5, 5) else None) for y in range(13) for x in range(17)]
    return spark.createDataFrame(rows, "x int, y int, value double").cache()


def as_dict(df, value):
    return {(r.x, r.y): r[value] for r in df.collect()}


@pytest.mark.parametrize("tile", [4, 100])
@pytest.mark.parametrize(("algorithm", "exponent"), [("mfd", 1.0), ("mfdw", 2.0), ("dinf", 1.0)])
def test_flow(cells, algorithm, exponent, tile):
    z = as_dict(cells, "value")
    flow = {p: 1.0 for p, v in z.items() if v is not None}
    for p in sorted(flow, key=lambda p: (-z[p], p[1], p[0])):
        if 0 < p[0] < 16 and 0 < p[1] < 12:
            beside = [(p[0] + dx, p[1] + dy) for dx, dy in spread.AROUND]
            for q, s in zip(beside, spread.flow_shares(z[p], [z[q] for q in beside], SPEC, algorithm, exponent), strict=True):
                if s and z[q] < z[p]:
                    flow[q] += s * flow[p]
    got = as_dict(spread.flow_accumulation(cells, SPEC, algorithm, exponent, tile=tile), "accumulation")
    assert got[5, 5] is None
    assert all(math.isclose(got[p], v, rel_tol=1e-9) for p, v in flow.items())


def test_flow_is_kept(cells):
    shares = spread.flow_shares(10.0, [1.0, 9.0, 12.0, None, 10.0, 3.0, 4.0, 8.0], SPEC, "mfd", 1.0)
    assert math.isclose(sum(shares), 1) and shares[2] == shares[3] == shares[4] == 0


@pytest.mark.parametrize("tile", [4, 100])
def test_cost_distance(cells, tile):
    cost = as_dict(cells, "value")
    best = {(2, 3): 0.0, (14, 9): 0.0}
    heap = [(0.0, p) for p in best]
    while heap:
        v, p = heapq.heappop(heap)
        for dx, dy in spread.AROUND:
            q = (p[0] + dx, p[1] + dy)
            if cost.get(q) is not None:
                new = v + cost[q] * (math.sqrt(2) if dx and dy else 1)
                if new < best.get(q, math.inf):
                    best[q] = new
                    heapq.heappush(heap, (new, q))
    source = (F.col("x") == 2) & (F.col("y") == 3) | (F.col("x") == 14) & (F.col("y") == 9)
    got = as_dict(spread.cost_distance(cells.withColumn("s", source), SPEC, "s", "value", tile=tile), "distance")
    assert got.pop((5, 5)) is None
    assert all(math.isclose(v, best[p], abs_tol=1e-9) for p, v in got.items())


def test_distance_without_sources(cells):
    assert set(as_dict(spread.euclidean_distance(cells, SPEC, [99.0]), "distance").values()) == {None}


@pytest.mark.parametrize("tile", [5, 64])
def test_tiles_agree(cells, tile):
    z = as_dict(cells, "value")
    want = {p: sum(z[min(16, max(0, p[0] + i)), min(12, max(0, p[1] + j))] == 7 for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2)) for p in z}
    old, focal.TILE = focal.TILE, tile
    try:
        assert as_dict(focal.neighbours_equal(cells, SPEC, 2, 7.0), "count") == want
    finally:
        focal.TILE = old


def test_empty_grids(spark, cells):
    none = cells.limit(0)
    assert zonal.zonal_statistics(none, "value", None).count() == 0
    assert focal.terrain(none, SPEC).count() == 0
    assert combine.unique_combinations(none, ["value"])[1].count() == 0
    assert sorting.sorted_cells(none, SPEC).count() == 0
    assert zonal.zonal_statistics(none, "value", None, every_key=True).count() == 0


def test_sorting_keeps_ties_in_order(cells):
    rows = sorting.sorted_cells(cells, SPEC).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(17 * 13))
    places = [(-1 if r.value is None else r.value, r["index"]) for r in rows]
    assert places == sorted(places)


def test_combination_overflow():
    with pytest.raises(OverflowError):
        combine.combination_code([F.lit(1), F.lit(1)], [1 << 40, 1 << 40])


def test_grids_of_other_size():
    with pytest.raises(ValueError, match="differ"):
        SPEC.same_cells(GridSpec(1, 1))


def test_random_cells_repeat(spark):
    assert random_cells(spark, SPEC, 0, 1, 5).collect() == random_cells(spark, SPEC, 0, 1, 5).collect()


def test_potentials_ties_and_none(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1.0, 0), (1, 0, -1.0, 0.0, 0), (2, 0, None, 3.0, 0), (3, 0, 5.0, 1.0, 8)], "x int, y int, a double, b double, m int")
    rows = overlay.potentials(df, ["a", "b"], [1, 2], "m").orderBy("x").collect()
    assert [(r.category, r.potential) for r in rows] == [(1, 1.0), (0, 0.0), (2, 3.0), (8, 0.0)]


def test_keys(spark):
    assert tables.key_of(spark.createDataFrame([("a", 1, 2)], "t string, n int, rowidx int")) == "rowidx"
    assert tables.key_of(spark.createDataFrame([("a", 1)], "t string, n int")) == "n"
    with pytest.raises(ValueError, match="key"):
        tables.key_of(spark.createDataFrame([("a",)], "t string"))


def test_stale_import(spark, tmp_path):
    source = tmp_path / "a.csv"
    source.write_text('id,name\n1,"x, y"\n')
    assert [tuple(r) for r in tables.imported_if_stale(spark, str(source), str(tmp_path / "store")).collect()] == [(1, "x, y")]
    source.write_text("id,name\n2,z\n")
    import os
    import time

    os.utime(source, (time.time() + 5, time.time() + 5))
    assert tables.imported_if_stale(spark, str(source), str(tmp_path / "store")).first().id == 2


def test_updates_leave_other_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k int, v string")
    rows = spark.createDataFrame([(2, "B"), (3, "D")], "k int, v string")
    assert sorted(map(tuple, attributes.updated(df, rows, ["k"]).collect()), key=str) == [(1, "a"), (2, "B"), (None, "c")]
    assert sorted(map(tuple, attributes.upserted(df, rows, ["k"]).collect()), key=str) == [(1, "a"), (2, "B"), (3, "D"), (None, "c")]
    assert attributes.appended_rows(df.limit(0), "k", 2).collect()[1].k == 1


@pytest.mark.parametrize("upstream", [False, True])
def test_flow_length(spark, upstream):
    """Longest ways by trying each step again until none gets longer, on a grid with gaps, in small tiles."""
    rng = random.Random(17)
    spec = GridSpec(11, 9, (0.0, 0.0), (2.0, 3.0))
    z = {(x, y): None if rng.random() < 0.08 else float(rng.randrange(20)) for x in range(11) for y in range(9)}
    w = {p: 1.0 + rng.randrange(3) for p in z}
    want, more = {p: 0.0 for p, v in z.items() if v is not None}, True
    while more:
        more = False
        for (x, y), have in list(want.items()):
            if not (0 < x < 10 and 0 < y < 8):
                continue
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    q = x + dx, y + dy
                    if want.get(q) is None or not (z[q] > z[x, y] if upstream else z[q] < z[x, y]):
                        continue
                    new = have + ((2 * dx) ** 2 + (3 * dy) ** 2) ** 0.5 * w[q]
                    if new > want[q] + 1e-9:
                        want[q], more = new, True
    cells = spark.createDataFrame([(x, y, v, w[x, y]) for (x, y), v in z.items()], "x int, y int, value double, weight double")
    got = {(r.x, r.y): r.length for r in spread.flow_length(cells, spec, upstream, weight="weight", tile=4).collect()}
    assert got.keys() == z.keys() and all(got[p] is None if p not in want else abs(got[p] - want[p]) < 1e-9 for p in got)


def test_grids_of_other_sizes(spark):
    one = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "x int, y int, value double")
    with pytest.raises(Exception, match="differ"):
        overlay.overlay({"a": one, "b": one.where("x = 0")}).collect()
    with pytest.raises(ValueError, match="differ in size"):
        overlay.overlay({"a": one, "b": one}, specs={"a": GridSpec(2, 1), "b": GridSpec(1, 1)})
    assert sorted(map(tuple, overlay.overlay({"a": one, "b": one}).collect())) == [(0, 0, 1.0, 1.0), (1, 0, 2.0, 2.0)]


def test_draws_hang_on_cells_alone(spark):
    other = random_cells(spark, SPEC, 0, 1, 5).repartition(7)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, random_cells(spark, SPEC, 0, 1, 5).collect()))
    values = [r.value for r in random_cells(spark, GridSpec(60, 60), 2, 4, 9).collect()]
    assert 2 <= min(values) < 2.05 and 3.95 < max(values) < 4 and abs(sum(values) / len(values) - 3) < 0.05


def test_linear_resampling_by_hand(spark):
    """Four corners weighed, in tiles smaller than the grid; a null or missing corner of some weight gives null, places outside get the given value."""
    rng = random.Random(23)
    source, target = GridSpec(9, 7, (1.0, 2.0), (2.0, 1.0)), GridSpec(12, 11, (0.0, 1.5), (1.7, 0.75))
    v = {(x, y): None if (x, y) == (3, 3) else rng.random() for x in range(9) for y in range(7) if (x, y) != (6, 2)}
    cells = spark.createDataFrame([(x, y, z) for (x, y), z in v.items()], "x int, y int, value double")
    want = {}
    for i in range(12):
        for j in range(11):
            sx, sy = (1.7 * i - 1) / 2, 1.5 + 0.75 * j - 2
            if not (0 <= sx <= 8 and 0 <= sy <= 6):
                want[i, j] = -1.0
                continue
            x, y = math.floor(sx), math.floor(sy)
            parts = [((1 - abs(sx - a)) * (1 - abs(sy - b)), v.get((a, b))) for a in (x, x + 1) for b in (y, y + 1) if abs(sx - a) < 1 and abs(sy - b) < 1]
            want[i, j] = None if any(z is None for _, z in parts) else sum(p * z for p, z in parts)
    assert None in want.values()
    for got in (geometry.resampled(cells, source, target, "linear", outside=-1.0), geometry._linear(cells, source, target, "value", 4)):
        found = {(r.x, r.y): r.value for r in got.collect()}
        inside = {p: z for p, z in want.items() if p in found}
        assert len(found) >= sum(z != -1.0 for z in want.values()) and all(z is None and found[p] is None or abs(found[p] - z) < 1e-9 for p, z in inside.items())
