"""Queries over grids."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from rasterloom.functions.complex import compiled_complex, pair
from rasterloom.functions.expressions import random_functions
from rasterloom.functions.matrix import compiled_matrix, number
from rasterloom.operators import combine, focal, geometry, overlay, sketches, sorting, spread, zonal
from rasterloom.plans.registry import WIDTH, event_grid, event_spec, registered, rounded, table
from rasterloom.sources import grids, rasters
from rasterloom.sources.stored import shared_folder

#: A draw from [0, 1) by md5 of a text; the text of a seed and an event's cell.
DRAW = "('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0"
CELL = "'{seed},' || (event_id % 100) || ',' || (event_id // 100)"
XY = "CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y"
STATS = ("min", "max", "mean", "stddev", "sum")
ZONES = """SELECT CAST(user_id AS BIGINT) AS rowidx, COUNT(*) AS "count", MIN(value) AS "min", MAX(value) AS "max", AVG(value) AS mean, STDDEV_POP(value) AS stddev, SUM(value) AS "sum",
  CAST(MIN(event_id % 100) AS INTEGER) AS "minX", CAST(MIN(event_id // 100) AS INTEGER) AS "minY", CAST(MAX(event_id % 100) AS INTEGER) AS "maxX", CAST(MAX(event_id // 100) AS INTEGER) AS "maxY" FROM events {where} GROUP BY user_id"""
ROUNDED = """rowidx, zone_id, "count", round("min", 6) AS "min", round("max", 6) AS "max", round(mean, 6) AS mean, round(stddev, 6) AS stddev, round("sum", 6) AS "sum", "minX", "minY", "maxX", "maxY\""""


def zones(spark, d, *more):
    return event_grid(spark, d, F.col("user_id").alias("zone"), "value", *more)


@registered("a1_zonal_statistics", f"WITH z AS ({ZONES.format(where='')}), n AS (SELECT *, row_number() OVER (ORDER BY rowidx) - 1 AS zone_id FROM z) SELECT {ROUNDED} FROM n")
def a1(spark, d):
    return rounded(zonal.zonal_statistics(zones(spark, d)), *STATS)


@registered("a1_zonal_statistics_nodata", f"WITH z AS ({ZONES.format(where='WHERE event_id % 13 <> 0')}), n AS (SELECT *, row_number() OVER (ORDER BY rowidx) - 1 AS zone_id FROM z) SELECT {ROUNDED} FROM n")
def a1_nodata(spark, d):
    cells = zones(spark, d).withColumn("value", F.when((F.col("y") * WIDTH + F.col("x")) % 13 != 0, F.col("value")))
    return rounded(zonal.zonal_statistics(cells), *STATS)


@registered("a4_zone_only", "SELECT user_id AS rowidx, row_number() OVER (ORDER BY user_id) - 1 AS zone_id, COUNT(*) AS \"count\", CAST(MIN(user_id) AS DOUBLE) AS \"min\", CAST(MAX(user_id) AS DOUBLE) AS \"max\" FROM events GROUP BY user_id")
def a4(spark, d):
    return zonal.zonal_statistics(zones(spark, d), value=None).select("rowidx", "zone_id", "count", "min", "max")


@registered("a5_every_zone", """WITH z AS (SELECT user_id * 2 AS k, COUNT(*) AS n, SUM(value) AS s FROM events GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS zone_id FROM z)
SELECT r.range AS rowidx, coalesce(zone_id, -1) AS zone_id, coalesce(n, 0) AS "count", round(coalesce(s, 0), 6) AS "sum" FROM range(0, (SELECT MAX(k) + 1 FROM z)) r LEFT JOIN i ON r.range = i.k""")
def a5(spark, d):
    cells = zones(spark, d).withColumn("zone", F.col("zone") * 2)
    return rounded(zonal.zonal_statistics(cells, every_key=True), "sum").select("rowidx", "zone_id", "count", "sum")


TWO = "SELECT event_id, CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS a, CAST(user_id % 7 AS INTEGER) AS b FROM events"


def two(spark, d):
    """Two category bands: the event type's rank, and the user's number modulo 7."""
    events = table(spark, d, "events")
    kinds = zonal.numbered(events.select("event_type").distinct(), "event_type", "a")
    rows = events.join(kinds, "event_type")
    return cells_two(rows)


def cells_two(rows):
    return grids.cells_of(rows, "event_id", WIDTH, F.col("a").cast("int").alias("a"), (F.col("user_id") % 7).cast("int").alias("b"))


@registered("a7_combination_codes", f"WITH t AS ({TWO}) SELECT x, y, CAST(CASE WHEN b = 3 THEN 0 ELSE 1 + a + b * 5 END AS BIGINT) AS code FROM t")
def a7(spark, d):
    cells = two(spark, d).withColumn("b", F.when(F.col("b") != 3, F.col("b")))
    return combine.combine(cells, ["a", "b"], [5, 7])[0].select("x", "y", "code")


@registered("a7_combination_table", f"WITH t AS ({TWO}), c AS (SELECT DISTINCT CAST(1 + a + b * 5 AS BIGINT) AS rowidx, a, b FROM t) SELECT rowidx, row_number() OVER (ORDER BY rowidx) - 1 AS \"UvId\", a, b FROM c")
def a7_table(spark, d):
    return combine.combine(two(spark, d), ["a", "b"], [5, 7])[1]


@registered("a7_combination_decoded", f"WITH t AS ({TWO}) SELECT DISTINCT CAST(1 + a + b * 5 AS BIGINT) AS rowidx, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM t")
def a7_decoded(spark, d):
    codes = combine.combine(two(spark, d), ["a", "b"], [5, 7])[1].select("rowidx")
    return combine.decoded(codes, ["a", "b"], [5, 7])


@registered("a8_unique_combinations", f"WITH t AS ({TWO}) SELECT dense_rank() OVER (ORDER BY a, b) AS rowidx, a, b, COUNT(*) AS \"count\" FROM t GROUP BY a, b")
def a8(spark, d):
    return combine.unique_combinations(two(spark, d), ["a", "b"])[1].select("rowidx", "a", "b", "count")


@registered("a8_combination_raster", f"WITH t AS ({TWO}) SELECT x, y, dense_rank() OVER (ORDER BY a, b) AS comb FROM t")
def a8_raster(spark, d):
    return combine.unique_combinations(two(spark, d), ["a", "b"])[0].select("x", "y", "comb")


@registered("a12_whole_statistics", "SELECT COUNT(value) AS \"count\", MIN(value) AS minimum, MAX(value) AS maximum, round(AVG(value), 6) AS mean, round(STDDEV_POP(value), 6) AS stddev, round(SUM(value), 4) AS \"sum\" FROM events")
def a12_whole(spark, d):
    return rounded(rounded(zonal.column_statistics(event_grid(spark, d, "value"), "value"), "mean", "stddev"), "sum", digits=4)


@registered("a12_grid_statistics", "SELECT COUNT(value) AS \"count\", MIN(value) AS minimum, MAX(value) AS maximum, round(AVG(value), 6) AS mean, round(STDDEV_POP(value), 6) AS stddev, round(SUM(value), 4) AS \"sum\" FROM events WHERE event_id % 100 BETWEEN 10 AND 59 AND event_id // 100 BETWEEN 2 AND 8")
def a12(spark, d):
    return rounded(rounded(zonal.column_statistics(grids.region(event_grid(spark, d, "value"), 10, 2, 50, 7), "value"), "mean", "stddev"), "sum", digits=4)


@registered("a12_median", "SELECT round(median(value), 6) AS median FROM events")
def a12_median(spark, d):
    return rounded(zonal.median(event_grid(spark, d, "value"), "value"), "median")


@registered("a22_sketches", """WITH t AS (SELECT event_type AS zone, value, user_id FROM events WHERE event_id % 100 < 64)
SELECT zone, COUNT(value) AS "count", true AS distinct_within, true AS median_within, true AS ninth_within FROM t GROUP BY zone""")
def a22_sketches(spark, d):
    """Distinct counts and quantiles of a region from stored sketches, and whether they lie within three times their errors of the exact ones."""
    cells = event_grid(spark, d, F.col("event_type").alias("zone"), "value", F.col("user_id").alias("user"))
    found = sketches.merged(sketches.sketched(cells, "zone", "value", "user", 16), [0.5, 0.9], "tx < 4")
    at = lambda k, sign: F.sum((F.col("value") < F.get("q", F.lit(k))).cast("long") if sign else (F.col("value") <= F.get("q", F.lit(k))).cast("long")) / F.count("value")
    region = cells.where("x < 64").join(found.withColumnRenamed("zone", "z"), F.col("zone") == F.col("z"))
    exact = region.groupBy("zone", "count", "distinct").agg(F.count_distinct("user").alias("users"), *(at(k, s).alias(f"{'below' if s else 'upto'}{k}") for k in (0, 1) for s in (True, False)))
    near = lambda k, rank: (F.col(f"below{k}") <= rank + 3 * sketches.RANK_ERROR) & (F.col(f"upto{k}") >= rank - 3 * sketches.RANK_ERROR)
    within = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1), 3 * sketches.DISTINCT_ERROR * F.col("users"))
    return exact.select("zone", "count", within.alias("distinct_within"), near(0, 0.5).alias("median_within"), near(1, 0.9).alias("ninth_within"))


@registered("a13_histogram", """WITH e AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events)
SELECT CAST(least(floor((value - lo) / ((hi - lo) / 32)), 31) AS INTEGER) AS bin, COUNT(*) AS "count" FROM events, e GROUP BY 1""")
def a13(spark, d):
    return zonal.histogram(event_grid(spark, d, "value"), "value", 32).drop("low")


OVER = "SELECT event_id, CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value AS b1, CAST(user_id AS DOUBLE) AS b2 FROM events"


def both(spark, d):
    spec = event_spec(spark, d)
    return overlay.overlay({"b1": event_grid(spark, d, "value"), "b2": event_grid(spark, d, F.col("user_id").cast("double").alias("value"))}, specs={"b1": spec, "b2": spec})


@registered("m1_map_algebra", f"WITH t AS ({OVER}) SELECT x, y, round(b1 * 2 + sqrt(b2) - pow(b1, 2) / 100, 6) + 0.0 AS out1, CAST(b1 > 50 AND b2 < 20 OR b1 < 5 AS DOUBLE) AS out2, CASE WHEN b1 > b2 THEN b1 ELSE b2 END AS out3 FROM t")
def m1(spark, d):
    out = overlay.map_algebra(both(spark, d), event_spec(spark, d), "b1 * 2 + sqrt(b2) - b1 ^ 2 / 100, b1 > 50 && b2 < 20 || b1 < 5, b1 > b2 ? b1 : b2")
    return rounded(out, "out1")


@registered("m2_table_lookup", "SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, round(c_acctbal * 0.5 + value, 6) + 0.0 AS out1 FROM events LEFT JOIN customer ON user_id = c_custkey")
def m2(spark, d):
    cells = event_grid(spark, d, "value", F.col("user_id").alias("zone"))
    looked = overlay.looked_up(cells, "zone", table(spark, d, "customer"), "c_custkey", ["c_acctbal"])
    return rounded(overlay.map_algebra(looked, event_spec(spark, d), "zone__c_acctbal * 0.5 + value"), "out1")


@registered("m3_text_attribute", "SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, CASE WHEN c_mktsegment = 'BUILDING' THEN value ELSE 0.0 END AS out1 FROM events JOIN customer ON user_id = c_custkey")
def m3(spark, d):
    cells = event_grid(spark, d, "value", F.col("user_id").alias("zone"))
    looked = overlay.looked_up(cells, "zone", table(spark, d, "customer"), "c_custkey", ["c_mktsegment"])
    return overlay.map_algebra(looked, event_spec(spark, d), "zone__c_mktsegment == 'BUILDING' ? value : 0")


@registered("m4_virtual_bands", f"SELECT {XY}, CAST((event_id % 100) + (event_id // 100) * 2 AS DOUBLE) AS out1, CAST(1000 + (event_id % 100) * 25 - (2000 + (event_id // 100) * -25) AS DOUBLE) AS out2 FROM events")
def m4(spark, d):
    spec = event_spec(spark, d)
    spec = grids.GridSpec(spec.width, spec.height, (1000.0, 2000.0), (25.0, -25.0))
    return overlay.map_algebra(event_grid(spark, d, "value"), spec, "idxX + idxY * 2, idxPhyX - idxPhyY")


@registered("m5_clamping", f"SELECT {XY}, CAST(trunc(greatest(0, least(255, value * 10 - 100))) AS SMALLINT) AS out1 FROM events")
def m5(spark, d):
    return overlay.map_algebra(event_grid(spark, d, "value"), event_spec(spark, d), "value * 10 - 100", "ubyte")


@registered("m5_clamp_counts", "SELECT COUNT(*) FILTER (value * 10 - 100 < 0) AS underflow, COUNT(*) FILTER (value * 10 - 100 > 255) AS overflow FROM events")
def m5_counts(spark, d):
    return overlay.clamp_counts(event_grid(spark, d, (F.col("value") * 10 - 100).alias("v")), "v", "ubyte")


NEAR = "WITH t AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, {value} AS v FROM events), g AS (SELECT MAX(x) AS mx, MAX(y) AS my FROM t), o AS (SELECT i.range AS dx, j.range AS dy FROM range(-{r}, {r} + 1) i, range(-{r}, {r} + 1) j), n AS (SELECT t.x, t.y, o.dx, o.dy, greatest(0, least(mx, t.x + dx)) AS nx, greatest(0, least(my, t.y + dy)) AS ny, (t.x + dx BETWEEN 0 AND mx AND t.y + dy BETWEEN 0 AND my) AS inside FROM t, g, o), w AS (SELECT n.x, n.y, n.dx, n.dy, n.inside, s.v FROM n JOIN t s ON s.x = n.nx AND s.y = n.ny)"


def windows(value="value", r=1):
    return NEAR.format(value=value, r=r)


@registered("m10_neighbour_count", windows("user_id % 7", 2) + " SELECT x, y, COUNT(*) FILTER (v = 3) AS \"count\" FROM w GROUP BY x, y")
def m10(spark, d):
    cells = event_grid(spark, d, (F.col("user_id") % 7).alias("value"))
    return focal.neighbours_equal(cells, event_spec(spark, d), 2, 3)


@registered("m11_distance_weights", windows("user_id % 7", 2) + """ SELECT x, y, round(coalesce(SUM(CASE WHEN inside AND v = 1 THEN CASE dx * dx + dy * dy WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 4 THEN 0.25 ELSE 0 END
  WHEN inside AND v = 2 THEN CASE dx * dx + dy * dy WHEN 1 THEN -1.0 WHEN 2 THEN -0.5 WHEN 4 THEN 0.125 ELSE 0 END ELSE 0 END), 0)::DOUBLE, 6) + 0.0 AS weight FROM w GROUP BY x, y""")
def m11(spark, d):
    cells = event_grid(spark, d, (F.col("user_id") % 7).alias("value"))
    return rounded(focal.distance_weights(cells, event_spec(spark, d), 2, [1, 2], [[1.0, 0.5, 0.25], [-1.0, -0.5, 0.125]]), "weight")


P = windows() + ", p AS (SELECT x, y, " + ", ".join(f"MAX(v) FILTER (dx = {k % 3 - 1} AND dy = {k // 3 - 1}) AS n{k}" for k in range(9)) + " FROM w GROUP BY x, y)"
HORN = "((n2 + 2 * n5 + n8) - (n0 + 2 * n3 + n6)) / 8 AS zx, ((n8 + 2 * n7 + n6) - (n2 + 2 * n1 + n0)) / 8 AS zy"
ZEVENBERGEN = "(n5 - n3) / 2 AS zx, (n1 - n7) / 2 AS zy"


@registered("m12_slope_degrees", P + f", s AS (SELECT x, y, {HORN} FROM p) SELECT x, y, round(degrees(atan(sqrt(zx * zx + zy * zy))), 6) + 0.0 AS slope FROM s")
def m12(spark, d):
    return rounded(focal.terrain(event_grid(spark, d, "value"), event_spec(spark, d)), "slope")


@registered("m12_slope_percent", P + f", s AS (SELECT x, y, {ZEVENBERGEN} FROM p) SELECT x, y, round(100 * sqrt(zx * zx + zy * zy), 6) + 0.0 AS slope FROM s")
def m12_percent(spark, d):
    return rounded(focal.terrain(event_grid(spark, d, "value"), event_spec(spark, d), unit="percent", algorithm="zevenbergen"), "slope")


@registered("m12_aspect", P + f", s AS (SELECT x, y, {HORN} FROM p), a AS (SELECT x, y, degrees(atan2(zy, zx) - pi() / 2) AS a FROM s) SELECT x, y, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) + 0.0 AS aspect FROM a")
def m12_aspect(spark, d):
    return rounded(focal.terrain(event_grid(spark, d, "value"), event_spec(spark, d), "aspect"), "aspect")


FLOW = ", f AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, user_id % 7 + 1.0 AS fa FROM events), s AS (SELECT p.x, p.y, fa, {h}, sin(atan(sqrt(zx * zx + zy * zy))) AS sb, sqrt(zx * zx + zy * zy) AS t FROM p JOIN f USING (x, y))"


@registered("m12_wetness", P + FLOW.format(h=HORN) + " SELECT x, y, round(CASE WHEN t = 0 THEN NULL ELSE ln(fa / (2 * sqrt(1 / pi())) / t) END, 6) + 0.0 AS wetness FROM s")
def m12_wetness(spark, d):
    cells = event_grid(spark, d, "value", (F.col("user_id") % 7 + 1.0).alias("fa"))
    return rounded(focal.terrain(cells, event_spec(spark, d), "wetness", flow="fa"), "wetness")


@registered("m12_sediment_transport", P + FLOW.format(h=HORN) + " SELECT x, y, round(pow(fa / 22.13, 0.6) * pow(sb / 0.0896, 1.3), 6) + 0.0 AS transport FROM s")
def m12_transport(spark, d):
    cells = event_grid(spark, d, "value", (F.col("user_id") % 7 + 1.0).alias("fa"))
    return rounded(focal.terrain(cells, event_spec(spark, d), "transport", flow="fa"), "transport")


@registered("m12_ls_factor", P + FLOW.format(h=HORN) + """, m AS (SELECT *, (sb / 0.0896) / (3 * pow(sb, 0.8) + 0.56) AS b, 2 * sqrt(1 / pi()) AS dm, atan2(zy, zx) - pi() / 2 AS turn FROM s), l AS (SELECT *, b / (1 + b) AS m FROM m)
SELECT x, y, round(CASE WHEN t = 0 THEN 1 ELSE (pow(fa, m + 1) - pow(fa - 1, m + 1)) / (pow(dm, m + 2) * pow(abs(sin(turn)) + abs(cos(turn)), m) * pow(22.13, m)) END * CASE WHEN 100 * t < 9 THEN 10.8 * sb + 0.03 ELSE 16.8 * sb - 0.5 END, 6) + 0.0 AS ls FROM l""")
def m12_ls(spark, d):
    cells = event_grid(spark, d, "value", (F.col("user_id") % 7 + 1.0).alias("fa"))
    return rounded(focal.terrain(cells, event_spec(spark, d), "ls", flow="fa"), "ls")


@registered("m8_kernel_script", windows() + " SELECT x, y, round(AVG(v) + MAX(CASE WHEN dx = 0 AND dy = 0 THEN v END) * 2, 6) + 0.0 AS result FROM w GROUP BY x, y")
def m8(spark, d):
    steps = {"total": "kwinVal(value, {i})", "mean": "total / numPix", "result": "mean + kwinVal(value, centrePixIdx) * 2"}
    return rounded(focal.kernel_script(event_grid(spark, d, "value"), event_spec(spark, d), 1, ["value"], steps, "result"), "result")


@registered("m7_kernel_loop", windows() + " SELECT x, y, round((SUM(v * sqrt(dx * dx + dy * dy)) / 8 - 1) * 2, 6) + 0.0 AS total FROM w GROUP BY x, y")
def m7_loop(spark, d):
    script = ["total = 0", "for k < numPix: total += kwinVal(value, k) * neigDist(k)", "total /= numPix - 1", "total -= 1", "total *= 2"]
    return rounded(focal.kernel_script(event_grid(spark, d, "value"), event_spec(spark, d), 1, ["value"], script, "total"), "total")


@registered("m7_kernel_newton", "WITH RECURSIVE t AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value, value AS root, 0 AS k FROM events UNION ALL SELECT x, y, value, CASE WHEN root = 0 THEN NULL ELSE (root + value / root) / 2 END, k + 1 FROM t WHERE k < 12) SELECT x, y, round(root, 6) + 0.0 AS root FROM t WHERE k = 12")
def m7_newton(spark, d):
    """A loop that reads its own variable twice, over windows of 49 cells."""
    script = ["v = kwinVal(value, centrePixIdx)", "root = v", "for k < 12: root = (root + v / root) / 2"]
    return rounded(focal.kernel_script(event_grid(spark, d, "value"), event_spec(spark, d), 3, ["value"], script, "root"), "root")


@registered("m7_kernel_blocks", windows() + """, c AS (SELECT x, y, list(v ORDER BY dy, dx) AS w FROM w GROUP BY x, y),
r AS (SELECT x, y, [[w[3 * i + 1], w[3 * i + 2], w[3 * i + 3]] FOR i IN range(0, 3)] AS m FROM c)
SELECT x, y, round(list_sum([greatest(q[1], q[2], q[3]) - least(q[1], q[2], q[3]) FOR q IN m]), 6) + 0.0 AS total FROM r""")
def m7_blocks(spark, d):
    """Loops within loops: the ranges of the window's rows, summed."""
    script = "total = 0; for i < 3: { low = kwinVal(value, i * 3); high = low; for j < 3: { c = kwinVal(value, i * 3 + j); low = min(low, c); high = max(high, c) }; total += high - low }"
    return rounded(focal.kernel_script(event_grid(spark, d, "value"), event_spec(spark, d), 1, ["value"], script, "total"), "total")


@registered("m7_kernel_tables", windows("user_id % 7", 1) + " SELECT x, y, round(SUM([0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5][v + 1] * sqrt(dx * dx + dy * dy))::DOUBLE, 6) + 0.0 AS result FROM w GROUP BY x, y")
def m7(spark, d):
    cells = event_grid(spark, d, (F.col("user_id") % 7).alias("value"))
    weights = {"w": [[0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5]]}
    return rounded(focal.kernel_script(cells, event_spec(spark, d), 1, ["value"], {"result": "tabVal('w', kwinVal(value, {i}), 0) * neigDist({i})"}, "result", weights), "result")


@registered("m9_tile_script", windows() + " SELECT x, y, MAX(v) - MIN(v) AS relief FROM w GROUP BY x, y")
def m9(spark, d):
    import numpy as np

    def relief(p):
        v = np.lib.stride_tricks.sliding_window_view(p, (3, 3))
        return {"relief": v.max(axis=(2, 3)) - v.min(axis=(2, 3))}

    return focal.tile_model(event_grid(spark, d, "value"), event_spec(spark, d), ["value"], relief, "x int, y int, relief double", radius=1)


@registered("m20_tile_model", f"SELECT {XY}, round(value * 0.9 + 1, 6) + 0.0 AS result FROM events")
def m20(spark, d):
    model = lambda p: {"result": p * 0.9 + 1}
    return rounded(focal.tile_model(event_grid(spark, d, "value"), event_spec(spark, d), ["value"], model, "x int, y int, result double"), "result")


@registered("m13_distance", """WITH t AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, user_id FROM events), s AS (SELECT x, y FROM t WHERE user_id = 3)
SELECT t.x, t.y, round(MIN(sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y))), 6) AS distance FROM t, s GROUP BY t.x, t.y""")
def m13(spark, d):
    cells = event_grid(spark, d, F.col("user_id").alias("value"))
    return rounded(spread.euclidean_distance(cells, event_spec(spark, d), [3]), "distance")


@registered("m13_buffer", """WITH t AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, user_id FROM events), s AS (SELECT x, y FROM t WHERE user_id = 3)
SELECT t.x, t.y, CAST(MAX(CASE WHEN (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) <= 16 THEN 9 ELSE 0 END) AS INTEGER) AS zone FROM t, s GROUP BY t.x, t.y""")
def m13_buffer(spark, d):
    cells = event_grid(spark, d, F.col("user_id").alias("value"))
    return spread.buffered(spread.euclidean_distance(cells, event_spec(spark, d), [3], 4.0), 9)


#: Cells, the steps between neighbours, and the ways down from cells within the grid: what flow and costs go along.
NEIGHBOURS = """t AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value AS z, user_id FROM events), n AS (SELECT MAX(y) AS bottom FROM t),
o(dx, dy) AS (SELECT a.range - 1, b.range - 1 FROM range(3) a, range(3) b WHERE a.range <> 1 OR b.range <> 1),
e AS MATERIALIZED (SELECT t.x, t.y, t.z, q.x AS qx, q.y AS qy, q.z AS qz, sqrt(dx * dx + dy * dy) AS step FROM t CROSS JOIN o JOIN t q ON q.x = t.x + dx AND q.y = t.y + dy),
d AS MATERIALIZED (SELECT e.* FROM e, n WHERE x > 0 AND x < 99 AND y > 0 AND y < bottom AND qz < z)"""
#: Flow parted by shares {p} of each way down, passed on until nothing moves.
FLOWS = """WITH RECURSIVE {neighbours}, {shares},
f AS (SELECT x, y, 1.0::DOUBLE AS amount, 0 AS k FROM t UNION ALL SELECT qx, qy, SUM(amount * share), k + 1 FROM f JOIN s USING (x, y) GROUP BY qx, qy, k)
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(SUM(amount), 6) + 0.0 AS accumulation FROM f GROUP BY x, y"""
PARTED = "w AS (SELECT x, y, qx, qy, {p} AS part FROM d), s AS MATERIALIZED (SELECT x, y, qx, qy, part / SUM(part) OVER (PARTITION BY x, y) AS share FROM w)"
#: The steepest of eight facets beside a cell within the grid; its flow goes to the facet's straight and its corner neighbour, by angle.
FACETS = """c AS (SELECT t.x, t.y, t.z, k, a.x AS ax, a.y AS ay, a.z AS az, b.x AS ux, b.y AS uy, b.z AS bz FROM t, n, (VALUES (0, 0, -1, -1, -1), (1, 0, -1, 1, -1), (2, 1, 0, 1, -1), (3, 1, 0, 1, 1), (4, 0, 1, 1, 1), (5, 0, 1, -1, 1), (6, -1, 0, -1, 1), (7, -1, 0, -1, -1)) v(k, sx, sy, cx, cy)
  JOIN t a ON a.x = t.x + sx AND a.y = t.y + sy JOIN t b ON b.x = t.x + cx AND b.y = t.y + cy WHERE t.x > 0 AND t.x < 99 AND t.y > 0 AND t.y < bottom),
g AS (SELECT *, atan2(az - bz, z - az) AS raw FROM c),
h AS (SELECT *, CASE WHEN raw < 0 THEN 0 WHEN raw > pi() / 4 THEN 1 ELSE raw / (pi() / 4) END AS part, CASE WHEN raw < 0 THEN z - az WHEN raw > pi() / 4 THEN (z - bz) / sqrt(2) ELSE sqrt((z - az) * (z - az) + (az - bz) * (az - bz)) END AS slope FROM g),
b AS (SELECT * FROM h WHERE slope > 0 QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY slope DESC, k) = 1),
s AS MATERIALIZED (SELECT x, y, ax AS qx, ay AS qy, 1 - part AS share FROM b WHERE part < 1 AND az < z UNION ALL SELECT x, y, ux, uy, part FROM b WHERE part > 0 AND bz < z)"""


@registered("m13_cost_distance", f"""WITH RECURSIVE {NEIGHBOURS},
w AS (SELECT x, y, 0.0::DOUBLE AS v, 0 AS k FROM t WHERE user_id = 3 UNION ALL SELECT qx, qy, MIN(v + (qz + 1) * step), k + 1 FROM w JOIN e USING (x, y) WHERE k < 100 GROUP BY qx, qy, k)
SELECT t.x, t.y, round(MIN(v), 6) + 0.0 AS distance FROM t LEFT JOIN w ON t.x = w.x AND t.y = w.y GROUP BY t.x, t.y""")
def m13_cost(spark, d):
    cells = event_grid(spark, d, (F.col("user_id") == 3).alias("source"), (F.col("value") + 1).alias("cost"))
    return rounded(spread.cost_distance(cells, event_spec(spark, d), "source", "cost", tile=64), "distance")


@registered("m14_flow_accumulation", FLOWS.format(neighbours=NEIGHBOURS, shares=PARTED.format(p="(z - qz) * CASE WHEN step > 1 THEN 0.354 ELSE 0.5 END")))
def m14(spark, d):
    return rounded(spread.flow_accumulation(event_grid(spark, d, "value"), event_spec(spark, d), "mfd", tile=64), "accumulation")


@registered("m14_flow_holmgren", FLOWS.format(neighbours=NEIGHBOURS, shares=PARTED.format(p="pow((z - qz) / step, 4)")))
def m14_holmgren(spark, d):
    return rounded(spread.flow_accumulation(event_grid(spark, d, "value"), event_spec(spark, d), "mfdw", 4.0, tile=64), "accumulation")


@registered("m14_flow_dinf", FLOWS.format(neighbours=NEIGHBOURS, shares=FACETS))
def m14_dinf(spark, d):
    return rounded(spread.flow_accumulation(event_grid(spark, d, "value"), event_spec(spark, d), "dinf", tile=64), "accumulation")


@registered("m14_flow_length", f"""WITH RECURSIVE {NEIGHBOURS}, w AS (SELECT x, y, 0.0::DOUBLE AS v, 0 AS k FROM t UNION ALL SELECT qx, qy, MAX(v + step), k + 1 FROM w JOIN d USING (x, y) GROUP BY qx, qy, k) SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(MAX(v), 6) + 0.0 AS length FROM w GROUP BY x, y""")
def m14_length(spark, d):
    return rounded(spread.flow_length(event_grid(spark, d, "value"), event_spec(spark, d), tile=64), "length")


@registered("m15_resample_nearest", """WITH t AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value FROM events)
SELECT CAST(i.range AS INTEGER) AS x, CAST(j.range AS INTEGER) AS y, t.value FROM range(0, 40) i, range(0, (SELECT CAST(ceil((MAX(event_id) // 100 + 1) / 2.5) AS BIGINT) FROM events)) j LEFT JOIN t ON t.x = floor(i.range * 2.5 + 0.5) AND t.y = floor(j.range * 2.5 + 0.5)""")
def m15_nearest(spark, d):
    spec = event_spec(spark, d)
    target = grids.GridSpec(math.ceil(spec.width / 2.5), math.ceil(spec.height / 2.5), (0.0, 0.0), (2.5, 2.5))
    return geometry.resampled(event_grid(spark, d, "value"), spec, target, "nearest")


@registered("m15_resample_linear", """WITH t AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value FROM events),
q AS (SELECT i.range AS x, j.range AS y, 0.25 + i.range * 1.5 AS sx, 0.5 + j.range * 1.5 AS sy FROM range(0, 66) i, range(0, (SELECT CAST(floor((MAX(event_id) // 100 - 0.5) / 1.5) AS BIGINT) + 1 FROM events)) j)
SELECT CAST(q.x AS INTEGER) AS x, CAST(q.y AS INTEGER) AS y, round(SUM(t.value * (1 - abs(q.sx - t.x)) * (1 - abs(q.sy - t.y))), 6) + 0.0 AS value FROM q JOIN t ON t.x BETWEEN floor(q.sx) AND floor(q.sx) + 1 AND t.y BETWEEN floor(q.sy) AND floor(q.sy) + 1 GROUP BY q.x, q.y""")
def m15_linear(spark, d):
    spec = event_spec(spark, d)
    target = grids.GridSpec(math.floor((spec.width - 1.25) / 1.5) + 1, math.floor((spec.height - 1.5) / 1.5) + 1, (0.25, 0.5), (1.5, 1.5))
    return rounded(geometry.resampled(event_grid(spark, d, "value"), spec, target, "linear"), "value")


def spline_sql(order):
    """The spline's values as sums: the filter's answer to one cell is a sum of its poles' powers, here 60 cells long."""
    poles, half = geometry.spline_poles(order), order // 2
    last = float(geometry.spline(order, geometry.np.array([float(half)]))[0])
    # Partial fractions: 1 / (last * product of (1 - z / w)(w - 1 / z) ...) at each pole.
    parts = []
    for z in poles:
        rest = 1.0
        for other in poles:
            if other != z:
                rest *= (z - other) * (z - 1 / other)
        parts.append((z ** (len(poles) - 1) / (last * (z - 1 / z) * rest), z))
    answer = " + ".join(f"({a!r}) * pow(({z!r})::DOUBLE, abs(j))" for a, z in parts)
    terms = " ".join(f"{'-' if j % 2 else '+'} {math.comb(order + 1, j)} * pow(greatest(t + {(order + 1) / 2} - {j}, 0), {order})" for j in range(order + 2))

    def axis(places, n):
        return f"""SELECT i, CASE WHEN r < {n} THEN r ELSE 2 * {n} - 2 - r END AS m, SUM(b * f) AS w FROM (
  SELECT i, (((k + j) % (2 * {n} - 2)) + 2 * {n} - 2) % (2 * {n} - 2) AS r, ({terms}) / {math.factorial(order)} AS b, {answer} AS f
  FROM (SELECT i, k, s - k AS t FROM ({places}), unnest(range(CAST(floor(s - {(order + 1) / 2}) AS BIGINT) + 1, CAST(floor(s - {(order + 1) / 2}) AS BIGINT) + {order + 2})) AS u(k)), range(-60, 61) AS v(j)) GROUP BY 1, 2"""

    return f"""WITH n AS (SELECT MAX(event_id) // 100 + 1 AS h FROM events),
t AS (SELECT event_id % 100 AS x, event_id // 100 AS y, value FROM events),
wx AS ({axis("SELECT range AS i, 0.25 + range * 1.5 AS s FROM range(0, 66)", "100")}),
wy AS ({axis("SELECT range AS i, 0.5 + range * 1.5 AS s FROM range(0, (SELECT CAST(floor((h - 1.5) / 1.5) AS BIGINT) + 1 FROM n))", "(SELECT h FROM n)")}),
a AS (SELECT wx.i, t.y, SUM(t.value * wx.w) AS v FROM t JOIN wx ON t.x = wx.m GROUP BY 1, 2)
SELECT CAST(a.i AS INTEGER) AS x, CAST(wy.i AS INTEGER) AS y, round(SUM(a.v * wy.w), 6) + 0.0 AS value FROM a JOIN wy ON a.y = wy.m GROUP BY a.i, wy.i"""


def m15_spline(order):
    @registered(f"m15_resample_bspline{order}", spline_sql(order))
    def query(spark, d):
        spec = event_spec(spark, d)
        target = grids.GridSpec(math.floor((spec.width - 1.25) / 1.5) + 1, math.floor((spec.height - 1.5) / 1.5) + 1, (0.25, 0.5), (1.5, 1.5))
        return rounded(geometry.resampled(event_grid(spark, d, "value"), spec, target, "bspline", order=order), "value")


for spline_order in (2, 3, 4, 5):
    m15_spline(spline_order)


@registered("m16_resample_mean", "SELECT CAST((event_id % 100) // 5 AS INTEGER) AS x, CAST((event_id // 100) // 5 AS INTEGER) AS y, round(AVG(value), 6) AS value FROM events GROUP BY 1, 2")
def m16_mean(spark, d):
    spec = event_spec(spark, d)
    return rounded(geometry.resampled(event_grid(spark, d, "value"), spec, geometry.shrunk(spec, 5), "mean"), "value")


@registered("m16_resample_median", "SELECT CAST((event_id % 100) // 5 AS INTEGER) AS x, CAST((event_id // 100) // 5 AS INTEGER) AS y, round(median(value), 6) AS value FROM events GROUP BY 1, 2")
def m16_median(spark, d):
    spec = event_spec(spark, d)
    return rounded(geometry.resampled(event_grid(spark, d, "value"), spec, geometry.shrunk(spec, 5), "median"), "value")


@registered("m17_cube_slices", "SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value * 2 AS value FROM events")
def m17(spark, d):
    cells = event_grid(spark, d, "value")
    cube = grids.slice_to_cube(cells, 0).unionByName(grids.slice_to_cube(cells.withColumn("value", F.col("value") * 2), 1))
    return grids.cube_to_slice(cube, 1)


@registered("m17_cube_dims", "SELECT CAST(event_id // 100 AS INTEGER) AS x, CAST(4 AS INTEGER) AS y, CAST(event_id % 100 AS INTEGER) AS z, value FROM events")
def m17_dims(spark, d):
    return grids.slice_to_cube(event_grid(spark, d, "value"), 4, (2, 0, 1))


POTENTIALS = "SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value - 40 AS p1, CAST(user_id % 50 AS DOUBLE) AS p2, CAST(CASE WHEN event_id % 11 = 0 THEN 5 ELSE 0 END AS INTEGER) AS mask FROM events"
CHOSEN = f"WITH t AS ({POTENTIALS}), c AS (SELECT x, y, CAST(CASE WHEN mask <> 0 THEN mask WHEN greatest(p1, p2) <= 0 THEN 0 WHEN p1 >= p2 THEN 10 ELSE 20 END AS INTEGER) AS category, CASE WHEN mask <> 0 THEN 0.0 ELSE greatest(0.0, p1, p2) END::DOUBLE AS potential FROM t)"


def potentials(spark, d):
    i = F.col("y") * WIDTH + F.col("x")
    cells = event_grid(spark, d, (F.col("value") - 40).alias("p1"), (F.col("user_id") % 50).cast("double").alias("p2"))
    return overlay.potentials(cells.withColumn("mask", F.when(i % 11 == 0, 5).otherwise(0)), ["p1", "p2"], [10, 20], "mask").select("x", "y", "category", "potential")


@registered("m18_lu_potentials", CHOSEN + " SELECT * FROM c")
def m18(spark, d):
    return potentials(spark, d)


@registered("m19_allocation", CHOSEN + " SELECT x, y, CAST(CASE WHEN category = 10 AND potential < 20 OR category = 20 AND potential < 30 THEN 0 ELSE category END AS INTEGER) AS category, potential FROM c")
def m19(spark, d):
    return overlay.allocated(potentials(spark, d), {10: 20.0, 20: 30.0})


@registered("p37_region", "SELECT CAST(event_id % 100 - 20 AS INTEGER) AS x, CAST(event_id // 100 - 3 AS INTEGER) AS y, value FROM events WHERE event_id % 100 BETWEEN 20 AND 49 AND event_id // 100 BETWEEN 3 AND 7")
def p37(spark, d):
    return grids.region(event_grid(spark, d, "value"), 20, 3, 30, 5)


@registered("p37_region_physical", "SELECT CAST(event_id % 100 - 20 AS INTEGER) AS x, CAST(event_id // 100 - 3 AS INTEGER) AS y, value FROM events WHERE event_id % 100 BETWEEN 20 AND 29 AND event_id // 100 BETWEEN 3 AND 4")
def p37_physical(spark, d):
    spec = grids.GridSpec(WIDTH, 1000, (100.0, 50.0), (10.0, 10.0))
    return grids.region_at(event_grid(spark, d, "value"), spec, (300.0, 80.0), (100.0, 20.0))


@registered("p38_band", f"SELECT {XY}, CAST(user_id AS DOUBLE) AS value FROM events")
def p38(spark, d):
    return overlay.band(both(spark, d), "b2")


@registered("p39_cast", f"SELECT {XY}, CAST(trunc(value) AS INTEGER) AS value FROM events")
def p39(spark, d):
    return event_grid(spark, d, F.col("value").cast("int").alias("value"))


@registered("p40_value_extractor", f"SELECT {XY}, c_acctbal AS value FROM events LEFT JOIN customer ON user_id = c_custkey")
def p40(spark, d):
    cells = event_grid(spark, d, F.col("user_id").alias("zone"))
    return overlay.looked_up(cells, "zone", table(spark, d, "customer"), "c_custkey", ["c_acctbal"]).select("x", "y", F.col("zone__c_acctbal").alias("value"))


@registered("s3_overview_mean", "SELECT CAST((event_id % 100) // 4 AS INTEGER) AS x, CAST((event_id // 100) // 4 AS INTEGER) AS y, round(AVG(value), 6) AS value FROM events GROUP BY 1, 2")
def s3(spark, d):
    return rounded(grids.overview(event_grid(spark, d, "value"), 2), "value")


@registered("s3_overview_first", "SELECT CAST((event_id % 100) // 4 AS INTEGER) AS x, CAST((event_id // 100) // 4 AS INTEGER) AS y, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def s3_first(spark, d):
    return grids.overview(event_grid(spark, d, "value"), 2, how="first")


@registered("s5_hyperslab", "SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value FROM events WHERE event_id % 100 BETWEEN 5 AND 14 AND event_id // 100 BETWEEN 1 AND 4")
def s5(spark, d):
    return grids.hyperslab(event_grid(spark, d, "value"), {"x": 5, "y": 1}, {"x": 10, "y": 4})


@registered("s2_flat_raster", f"SELECT {XY}, CASE WHEN event_id % 13 <> 0 THEN value END AS value, CASE WHEN event_id % 13 <> 0 THEN value * 2 END AS twice FROM events WHERE event_id % 100 BETWEEN 20 AND 79 AND event_id // 100 >= 3")
def s2_flat(spark, d):
    """The grid as a flat raster of strips with headers, and a window of it read back."""
    path, spec = f"{shared_folder(spark)}/flat-{uuid.uuid4().hex}", event_spec(spark, d)
    there = F.when((F.col("y") * WIDTH + F.col("x")) % 13 != 0, F.col("value"))
    cells = event_grid(spark, d, "value").withColumn("value", there)
    rasters.write_raster(cells.withColumn("twice", F.col("value") * 2), spec, path, "flat", 16, nodata=-9999.0)
    return rasters.read_raster(spark, path, "flat", within={"x": (20, 79), "y": (3, spec.height - 1)})


@registered("s5_netcdf", f"SELECT {XY}, value, CAST(user_id AS INTEGER) AS zone FROM events WHERE event_id % 100 < 50 AND event_id // 100 BETWEEN 2 AND 70")
def s5_netcdf(spark, d):
    """The grid and its zones as classic NetCDF, and a hyperslab of both read back."""
    path, spec = f"{shared_folder(spark)}/netcdf-{uuid.uuid4().hex}", event_spec(spark, d)
    rasters.write_raster(event_grid(spark, d, "value", F.col("user_id").cast("int").alias("zone")), spec, path, "netcdf", 16)
    return rasters.read_raster(spark, path, "netcdf", within={"x": (0, 49), "y": (2, 70)})


@registered("s12_write_and_read", f"SELECT {XY}, value FROM events")
def s12(spark, d):
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    grids.write_cells(event_grid(spark, d, "value"), path, 64)
    return grids.read_cells(spark, path, ["value"])


@registered("s13_update_region", f"SELECT {XY}, CASE WHEN event_id % 100 BETWEEN 10 AND 19 AND event_id // 100 BETWEEN 1 AND 3 THEN -1.0 ELSE value END AS value FROM events")
def s13(spark, d):
    cells = event_grid(spark, d, "value")
    return grids.update_region(cells, grids.region(cells, 10, 1, 10, 3, shift=False).withColumn("value", F.lit(-1.0)))


@registered("s16_random_grid", f"SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, round(10 * ({DRAW.format(key=CELL.format(seed=7))}), 6) AS value FROM events")
def s16(spark, d):
    return rounded(grids.random_cells(spark, event_spec(spark, d), 0.0, 10.0, 7), "value")


@registered("s17_grid_to_table", "SELECT event_id % 100 AS x_id, event_id // 100 AS y_id, value AS dem, (event_id // 100) * 10.0::DOUBLE AS lat FROM events")
def s17(spark, d):
    cells = event_grid(spark, d, "value")
    axis = cells.select(F.col("y").cast("long").alias("y_id"), (F.col("y") * 10.0).alias("lat")).distinct()
    return grids.to_table(cells, "dem", auxiliary={"lat": axis}).select("x_id", "y_id", "dem", "lat")


@registered("s17_update_mode", "SELECT event_id % 100 AS x_id, event_id // 100 AS y_id, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END AS dem FROM events")
def s17_update(spark, d):
    image = grids.to_table(event_grid(spark, d, "value"), "dem")
    return grids.update_table(image, image.where("x_id % 2 = 0").withColumn("dem", F.col("dem") * 2), ["x_id", "y_id"], "dem")


@registered("s18_table_to_grid", "SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, CASE WHEN value > 20 THEN value ELSE -9999.0 END AS value FROM events")
def s18(spark, d):
    rows = grids.to_table(event_grid(spark, d, "value"), "dem")
    return grids.to_grid(rows, event_spec(spark, d), "x_id", "y_id", "dem", "dem > 20", -9999.0)


@registered("l1_sorted_cells", "SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS rank, event_id AS \"index\", value FROM events")
def l1(spark, d):
    return sorting.sorted_cells(event_grid(spark, d, "value"), event_spec(spark, d)).select("rank", "index", "value")


@registered("l2_sorted_descending", "SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS rank, event_id AS \"index\", value, user_id AS zone FROM events")
def l2(spark, d):
    cells = event_grid(spark, d, "value", F.col("user_id").alias("zone"))
    return sorting.sorted_cells(cells, event_spec(spark, d), ascending=False, dependent=["zone"]).select("rank", "index", "value", "zone")


@registered("f24_matrices", f"""WITH z AS (SELECT {XY}, value AS v, (user_id % 5)::DOUBLE AS u FROM events)
SELECT x, y, round(v * 2 + u, 6) + 0.0 AS corner, round((v + 1) + (u + 2) + 3 + (v + 4), 6) + 0.0 AS total, round(v * 3 + u * 4, 6) + 0.0 AS upper, round(2 * 3 + v * 4, 6) + 0.0 AS lower FROM z""")
def f24(spark, d):
    """Matrices made of a cell's values: an element of a product, a sum of elements, a matrix times a column."""
    cells = event_grid(spark, d, "value", F.col("user_id"))
    z = {"v": number(F.col("value")), "u": number(F.col("user_id") % 5)}
    of = {"corner": "({{v, u}, {2, v}} * {{2, 0}, {1, 5}})[0, 0]", "total": "sum({{v, u}, {2, v}} + {{1, 2}, {1, 4}})", "upper": "({{v, u}, {2, v}} * {3, 4}')[0]", "lower": "({{v, u}, {2, v}} * {3, 4}')'[0, 1]"}
    return rounded(cells.select("x", "y", *(compiled_matrix(text, z).column.alias(n) for n, text in of.items())), *of)


#: z = a + bi of a cell, and the values of three expressions of it in real arithmetic.
COMPLEX = f"""WITH z AS (SELECT {XY}, value / 100 - 1 AS a, (user_id % 7 - 3) / 2.0::DOUBLE AS b FROM events),
e AS (SELECT x, y, exp(a) * cos(b) AS er, exp(a) * sin(b) AS ei, a * a - b * b AS sr, 2 * a * b AS si, sqrt((sqrt(a * a + b * b) + a) / 2) AS qr, CASE WHEN b < 0 THEN -1 ELSE 1 END * sqrt((sqrt(a * a + b * b) - a) / 2) AS qi FROM z)
SELECT x, y, round(er + sr, 6) + 0.0 AS sum_re, round(ei + si, 6) + 0.0 AS sum_im, round(qr, 6) + 0.0 AS root_re, round(qi, 6) + 0.0 AS root_im, round(sqrt(er * er + ei * ei), 6) + 0.0 AS size FROM e"""


@registered("f25_complex", COMPLEX)
def f25(spark, d):
    cells = event_grid(spark, d, (F.col("value") / 100 - 1).alias("a"), ((F.col("user_id") % 7 - 3) / 2).alias("b"))
    z = {"z": pair(F.col("a"), F.col("b"))}
    of = {"sum": "exp(z) + z * z", "root": "sqrt(z)", "size": "abs(exp(z))"}
    out = cells.select("x", "y", *(compiled_complex(text, z).alias(n) for n, text in of.items()))
    return rounded(out.select("x", "y", F.col("sum.re").alias("sum_re"), F.col("sum.im").alias("sum_im"), F.col("root.re").alias("root_re"), F.col("root.im").alias("root_im"), F.col("size.re").alias("size")), "sum_re", "sum_im", "root_re", "root_im", "size")


@registered("f11_random_functions", f"""WITH d AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, {DRAW.format(key=CELL.format(seed=3))} AS u, sqrt(-2 * ln(1 - {DRAW.format(key=CELL.format(seed=4))})) * cos(2 * pi() * {DRAW.format(key=CELL.format(seed=5))}) AS z FROM events)
SELECT x, y, round(u, 6) + 0.0 AS out1, floor(1 + 6 * u) AS out2, round(5 + 2 * z, 6) + 0.0 AS out3, round(exp(z), 6) + 0.0 AS out4 FROM d""")
def f11(spark, d):
    return rounded(overlay.map_algebra(event_grid(spark, d, "value"), event_spec(spark, d), "rand(0, 1), unifdist_int(1, 6), normdist(5, 2), lndist(0, 1)", functions=random_functions(3)), "out1", "out3", "out4")


@registered("m8_circular_window", """WITH t AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value FROM events), h AS (SELECT MAX(y) AS y FROM t),
o(dx, dy) AS (VALUES (-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0), (0, -1), (0, 1))
SELECT t.x, t.y, round(SUM(n.value), 6) + 0.0 AS total FROM t, h, o JOIN t n ON n.x = greatest(0, least(99, t.x + dx)) AND n.y = greatest(0, least(h.y, t.y + dy)) GROUP BY t.x, t.y""")
def m8_circular(spark, d):
    cells = focal.windowed(event_grid(spark, d, "value"), event_spec(spark, d), (2, 1), ["value"], circular=True)
    return rounded(cells.select("x", "y", F.aggregate("win_value", F.lit(0.0), lambda a, v: a + v).alias("total")), "total")


EXPRESSIONS = {
    "f10_constants": ("value * log2e + log10e - ln2 * ln10 + euler", "value / ln(2) + 1 / ln(10) - ln(2) * ln(10) + 0.5772156649015329"),
    "f19_sizeof": ("sizeof(value, zone, 3) + max(value, zone) - min(zone, value, 4)", "3 + greatest(value, zone) - least(zone, value, 4)"),
    "f20_bits": ("(zone & 6) + (zone | 8) + (zone << 2) + (zone >> 1) + (value > 50 and zone > 3 or zone == 1)", "(zone & 6) + (zone | 8) + zone * 4 + zone // 2 + CASE WHEN value > 50 AND zone > 3 OR zone = 1 THEN 1 ELSE 0 END"),
    "f22_casts": ("(int)(value / 7) + (float)zone + 4! + (int)(0 - value) + !(zone > 3)", "trunc(value / 7) + zone + 24 + trunc(-value) + CASE WHEN zone > 3 THEN 0 ELSE 1 END"),
    "f23_text": ("strlen(concat(toupper(name), 'x')) + str2dbl('2.5') + strlen(tolower(name))", "length(upper(name) || 'x') + 2.5 + length(lower(name))"),
    "f26_units": ("value * 2k + 3m - 1M / 1k", "value * 2000 + 0.003 - 1000"),
}
for _name, (_text, _sql) in EXPRESSIONS.items():

    def _expression(spark, d, text=_text):
        cells = event_grid(spark, d, "value", (F.col("user_id") % 7).alias("zone"), F.col("event_type").alias("name"))
        return rounded(overlay.map_algebra(cells, event_spec(spark, d), text), "out1")

    registered(_name, f"WITH t AS (SELECT {XY}, value, user_id % 7 AS zone, event_type AS name FROM events) SELECT x, y, round(CAST({_sql} AS DOUBLE), 6) + 0.0 AS out1 FROM t")(_expression)
