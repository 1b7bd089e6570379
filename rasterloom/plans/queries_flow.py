"""Queries over models, streams and land-use optimisation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom.functions.parameters import resolved
from rasterloom.operators import allocation, overlay, tiles
from rasterloom.plans import model
from rasterloom.plans.sql import run_sql
from rasterloom.plans.registry import event_grid, event_spec, registered, rounded, table
from rasterloom.sources.stored import shared_folder
from rasterloom.streaming import zonal as streaming

#: Features are parts: area p_size, present land use by key, scores from the retail price.
FEATURES = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS area, CASE p_partkey % 3 WHEN 0 THEN 'pasture' WHEN 1 THEN 'forest' ELSE 'crop' END AS use, p_retailprice / 1000 AS s_pasture, CAST(p_partkey % 5 AS DOUBLE) AS s_forest, CAST(p_partkey % 7 AS DOUBLE) / 3 AS s_crop, p_partkey % 10 AS zone FROM part"
OPTIONS = ["pasture", "forest", "crop"]
SCORES = {"gain": {o: f"s_{o}" for o in OPTIONS}}
VARIABLES = f"f AS ({FEATURES}), v AS (SELECT id AS feature, o.option, 'X_' || id || '_' || o.k AS variable, area, CASE o.k WHEN 0 THEN s_pasture WHEN 1 THEN s_forest ELSE s_crop END AS gain, zone, use FROM f, (VALUES (0, 'pasture'), (1, 'forest'), (2, 'crop')) o(k, option))"
BEST = f"WITH {VARIABLES}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, option) AS n FROM v), b AS (SELECT * FROM r WHERE n = 1 AND gain > 0)"


def features(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS id", "CAST(p_size AS DOUBLE) AS area", "CASE p_partkey % 3 WHEN 0 THEN 'pasture' WHEN 1 THEN 'forest' ELSE 'crop' END AS use", "p_retailprice / 1000 AS s_pasture", "CAST(p_partkey % 5 AS DOUBLE) AS s_forest", "CAST(p_partkey % 7 AS DOUBLE) / 3 AS s_crop", "p_partkey % 10 AS zone")


def rows(spark, d):
    return allocation.variables(features(spark, d), "id", "area", OPTIONS, SCORES)


@registered("o1_baseline", f"WITH f AS ({FEATURES}) SELECT id, round(CASE use WHEN 'pasture' THEN s_pasture * area WHEN 'forest' THEN s_forest * area ELSE s_crop * area END, 6) AS \"gain_CUR\" FROM f")
def o1(spark, d):
    return rounded(allocation.baseline(features(spark, d), "use", "area", SCORES), "gain_CUR").select("id", "gain_CUR")


@registered("o2_variables", f"WITH {VARIABLES} SELECT feature, option, variable, area, round(gain, 6) AS gain FROM v")
def o2(spark, d):
    return rounded(rows(spark, d), "gain")


@registered("o3_objective", f"WITH {VARIABLES} SELECT 'objective' AS \"row\", variable, round(gain * 2.5, 6) AS coef FROM v")
def o3(spark, d):
    return rounded(allocation.objective(rows(spark, d), {"gain": 2.5}), "coef")


@registered("o5_areal_constraint", f"WITH {VARIABLES}, z AS (SELECT * FROM v WHERE feature % 10 = 4) SELECT 'areal' AS \"row\", '<=' AS sense, round(SUM(area) * 0.2, 6) AS rhs FROM (SELECT DISTINCT feature, area FROM z)")
def o5(spark, d):
    return rounded(allocation.option_constraint(rows(spark, d), ["crop"], "<=", 20, "percent_of_zone", F.col("feature") % 10 == 4)[1], "rhs")


@registered("o5_areal_coefficients", f"WITH {VARIABLES} SELECT 'areal' AS \"row\", variable, CAST(1 AS DOUBLE) AS coef FROM v WHERE option = 'crop' AND feature % 10 = 4")
def o5_coefs(spark, d):
    return allocation.option_constraint(rows(spark, d), ["crop"], "<=", 20, "percent_of_zone", F.col("feature") % 10 == 4)[0]


@registered("o5_percent_of_selected", f"WITH {VARIABLES} SELECT 'areal' AS \"row\", '>=' AS sense, round(SUM(area) * 0.35, 6) AS rhs FROM (SELECT DISTINCT feature, area FROM v WHERE area > 25)")
def o5_selected(spark, d):
    return rounded(allocation.option_constraint(rows(spark, d), ["crop", "forest"], ">=", 35, "percent_of_selected", selected=F.col("area") > 25)[1], "rhs")


@registered("o4_objective_constraint", f"WITH {VARIABLES} SELECT 'criterion' AS \"row\", variable, round(gain, 6) AS coef, '>=' AS sense, CAST(120 AS DOUBLE) AS rhs FROM v")
def o4(spark, d):
    coefs, side = allocation.criterion_constraint(rows(spark, d), "gain", ">=", 120)
    return rounded(coefs.join(side, "row"), "coef").select("row", "variable", "coef", "sense", "rhs")


@registered("o6_feature_areas", f"WITH {VARIABLES} SELECT DISTINCT 'area_' || feature AS \"row\", '<=' AS sense, area AS rhs FROM v")
def o6(spark, d):
    return allocation.area_constraints(rows(spark, d))[1]


@registered("o7_zone_constraints", f"WITH f AS ({FEATURES}) SELECT 'zone_' || zone AS \"row\", '<=' AS sense, MIN(area * 10) AS rhs FROM f GROUP BY zone")
def o7(spark, d):
    group = features(spark, d).select(F.col("id").alias("feature"), F.col("zone").alias("set"), (F.col("area") * 10).alias("bound"))
    return allocation.grouped_constraints(rows(spark, d), group, ["forest", "crop"], "<=", "bound", "zone")[1]


@registered("o7_first_record", f"WITH f AS ({FEATURES}) SELECT 'set_' || zone AS \"row\", '>=' AS sense, arg_min(area * 2, id) AS rhs FROM f GROUP BY zone")
def o7_first(spark, d):
    group = features(spark, d).select(F.col("id").alias("feature"), F.col("zone").alias("set"), (F.col("area") * 2).alias("bound"))
    return allocation.grouped_constraints(rows(spark, d), group, ["crop"], ">=", "bound", "set", record="feature")[1]


@registered("o8_criterion_constraint", f"WITH {VARIABLES} SELECT 'criterion' AS \"row\", variable, round(gain, 6) AS coef FROM v")
def o8(spark, d):
    return rounded(allocation.criterion_constraint(rows(spark, d), "gain", ">=", 100)[0], "coef")


@registered("o9_separable_solution", BEST + " SELECT feature, option, area AS value FROM b")
def o9(spark, d):
    return allocation.solved_by_feature(rows(spark, d), {"gain": 1.0})


#: At most 40 percent of the area under forest and crop: the best of these takes a feature from the best of the others, from the dearest area on.
AREAL = f"""WITH {VARIABLES}, r AS (SELECT feature, area, greatest(MAX(gain) FILTER (option = 'pasture'), 0) AS g0, MAX(gain) FILTER (option <> 'pasture') AS g1, arg_max(option, gain) FILTER (option = 'crop' OR option = 'forest') AS o1 FROM (SELECT * FROM v ORDER BY option) GROUP BY 1, 2),
b AS (SELECT 0.4 * SUM(area) AS most FROM f),
s AS (SELECT feature, area, o1, SUM(area) OVER (ORDER BY (g1 - g0) DESC, feature ROWS UNBOUNDED PRECEDING) - area AS used FROM r WHERE g1 > g0),
t AS (SELECT feature, o1 AS option, least(area, most - used) AS value FROM s, b WHERE used < most)
SELECT feature, option, round(value, 6) AS value FROM t
UNION ALL SELECT r.feature, 'pasture', round(r.area - coalesce(t.value, 0), 6) FROM r LEFT JOIN t ON r.feature = t.feature WHERE r.g0 > 0 AND r.area > coalesce(t.value, 0)"""


@registered("o9_areal_bound", AREAL)
def o9_areal(spark, d):
    v = rows(spark, d)
    most = 0.4 * features(spark, d).agg(F.sum("area")).first()[0]
    return rounded(allocation.solved_with_bound(v, F.col("gain"), F.col("option").isin("forest", "crop").cast("int"), "<=", most), "value")


#: Costs a unit of area of each option, as a second criterion, and a floor under their sum that the free optimum misses.
COSTED = f"""{VARIABLES}, p AS (SELECT feature, area, option, CASE option WHEN 'pasture' THEN 1 + feature % 3 WHEN 'forest' THEN 2 + feature % 4 ELSE 4 END::DOUBLE AS use, gain FROM v
  UNION ALL SELECT id, area, NULL, 0.0, 0.0 FROM f),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY feature, use ORDER BY gain DESC, coalesce(option, '')) = 1),
e AS (SELECT a.feature, a.area, a.option AS before, b.option, a.use AS ua, b.use AS ub, a.gain AS ga, b.gain AS gb FROM d a JOIN d b ON a.feature = b.feature AND a.use < b.use),
h AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.feature = e.feature AND d.use NOT IN (ua, ub) AND (d.gain - ga) * (ub - ua) > (gb - ga) * (d.use - ua) + 1e-12)
  AND NOT EXISTS (SELECT 1 FROM d WHERE d.feature = e.feature AND d.use > ua AND d.use < ub AND abs((d.gain - ga) * (ub - ua) - (gb - ga) * (d.use - ua)) <= 1e-12)),
s AS (SELECT *, (gb - ga) / (ub - ua) AS slope, (ub - ua) * area AS take, SUM((ub - ua) * area) OVER (ORDER BY (gb - ga) / (ub - ua) DESC, feature, ua ROWS UNBOUNDED PRECEDING) AS upto FROM h)"""


@registered("o9_budget", f"""WITH {COSTED}, b AS (SELECT least({{amount}}, SUM(take) FILTER (slope > 0)) AS most FROM s),
t AS (SELECT *, least(1, (most - (upto - take)) / take) AS share FROM s, b WHERE upto - take < most),
l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY feature ORDER BY ua DESC) = 1),
o AS (SELECT feature, option, area * share AS value FROM l UNION ALL SELECT feature, before, area * (1 - share) FROM l)
SELECT feature, option, round(value, 6) AS value FROM o WHERE option IS NOT NULL AND value > 0""".replace("{amount}", "(SELECT 1.5 * SUM(area) FROM f)"))
def o9_budget(spark, d):
    use = F.when(F.col("option") == "pasture", 1 + F.col("feature") % 3).when(F.col("option") == "forest", 2 + F.col("feature") % 4).otherwise(4)
    most = 1.5 * features(spark, d).agg(F.sum("area")).first()[0]
    return rounded(allocation.solved_with_bound(rows(spark, d), F.col("gain"), use, "<=", most), "value")


@registered("o9_least_use", f"""WITH {COSTED}, b AS (SELECT greatest(3.6 * SUM(area), (SELECT SUM(take) FILTER (slope > 0) FROM s)) AS least FROM f),
t AS (SELECT *, least(1, (b.least - (upto - take)) / take) AS share FROM s, b WHERE upto - take < b.least),
l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY feature ORDER BY ua DESC) = 1),
o AS (SELECT feature, option, area * share AS value FROM l UNION ALL SELECT feature, before, area * (1 - share) FROM l)
SELECT feature, option, round(value, 6) AS value FROM o WHERE option IS NOT NULL AND value > 0""")
def o9_least(spark, d):
    use = F.when(F.col("option") == "pasture", 1 + F.col("feature") % 3).when(F.col("option") == "forest", 2 + F.col("feature") % 4).otherwise(4)
    least = 3.6 * features(spark, d).agg(F.sum("area")).first()[0]
    return rounded(allocation.solved_with_bound(rows(spark, d), F.col("gain"), use, ">=", least), "value")


@registered("o10_result_columns", BEST + """ SELECT f.id, coalesce(b.option, '') AS "OPT_STR", CASE WHEN option = 'pasture' THEN b.area ELSE 0.0 END AS "OPT0_VAL", CASE WHEN option = 'forest' THEN b.area ELSE 0.0 END AS "OPT1_VAL", CASE WHEN option = 'crop' THEN b.area ELSE 0.0 END AS "OPT2_VAL" FROM f LEFT JOIN b ON f.id = b.feature""")
def o10(spark, d):
    f = features(spark, d)
    return allocation.result_columns(f, "id", o9(spark, d), OPTIONS).select("id", "OPT_STR", "OPT0_VAL", "OPT1_VAL", "OPT2_VAL")


#: A draw from [0, 1) by md5 of a text.
DRAW = "('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0"


@registered("o11_perturbed_scores", f"WITH f AS ({FEATURES}), r AS (SELECT *, floor({DRAW.format(key="'3,' || id")} * 21) - 10 AS p FROM f) SELECT id, round(greatest(0, s_pasture + s_pasture * p / 100), 6) AS s_pasture FROM r")
def o11(spark, d):
    return rounded(allocation.perturbed(features(spark, d), "s_pasture", 10, 3).select("id", "s_pasture"), "s_pasture")


@registered("o12_batch_runs", f"""WITH f AS ({FEATURES}), r AS (SELECT CAST(u AS INTEGER) AS uncertainty, CAST(n.range AS INTEGER) AS run, s_pasture, floor({DRAW.format(key="'11,' || u || ',' || n.range || ',' || id")} * (2 * u + 1)) - u AS p FROM f, (VALUES (5), (10)) l(u), range(0, 3) n)
SELECT uncertainty, run, COUNT(*) AS features, round(SUM(greatest(0, s_pasture + s_pasture * p / 100)), 6) AS gain FROM r GROUP BY ALL""")
def o12(spark, d):
    return rounded(allocation.batch_runs(features(spark, d), "s_pasture", [5, 10], 3, 11).groupBy("uncertainty", "run").agg(F.count("*").alias("features"), F.sum("s_pasture").alias("gain")), "gain")


@registered("o13_program_text", f"""WITH {VARIABLES}, s AS (SELECT DISTINCT 'area_' || feature AS "row", area FROM v)
SELECT CAST(0 AS INTEGER) AS section, 'objective' AS "row", CAST(0 AS INTEGER) AS place, '' AS term, 'max:' AS line
UNION ALL SELECT 0, 'objective', 1, variable, printf('%+.6f', gain) || ' ' || variable FROM v
UNION ALL SELECT 0, 'objective', 2, '', ';'
UNION ALL SELECT 1, "row", 0, '', "row" || ':' FROM s
UNION ALL SELECT 1, 'area_' || feature, 1, variable, printf('%+.6f', 1.0) || ' ' || variable FROM v
UNION ALL SELECT 1, "row", 2, '', '<= ' || printf('%.6f', area) || ';' FROM s""")
def o13(spark, d):
    v = rows(spark, d)
    return allocation.program_lines(allocation.objective(v, {"gain": 1.0}), *allocation.area_constraints(v))


@registered("a19_result_summary", BEST + """, c AS (SELECT use AS option, SUM(area) AS a FROM f GROUP BY 1), o AS (SELECT option, SUM(area) AS a FROM b GROUP BY 1), j AS (SELECT coalesce(c.option, o.option) AS option, coalesce(c.a, 0) AS cur_area, coalesce(o.a, 0) AS opt_area FROM c FULL JOIN o ON c.option = o.option), t AS (SELECT * FROM j UNION ALL SELECT 'total', SUM(cur_area), SUM(opt_area) FROM j)
SELECT option, cur_area, opt_area, opt_area - cur_area AS diff, round((opt_area - cur_area) * 100 / cur_area, 6) + 0.0 AS rel_diff FROM t""")
def a19(spark, d):
    return rounded(allocation.result_summary(features(spark, d), "use", "area", o9(spark, d)), "rel_diff")


@registered("a19_change_matrix", BEST + """ SELECT use, coalesce(SUM(b.area) FILTER (option = 'pasture'), 0.0) AS pasture, coalesce(SUM(b.area) FILTER (option = 'forest'), 0.0) AS forest, coalesce(SUM(b.area) FILTER (option = 'crop'), 0.0) AS crop FROM b GROUP BY use""")
def a19_matrix(spark, d):
    both = features(spark, d).join(o9(spark, d), F.col("id") == F.col("feature"))
    return allocation.change_matrix(both, "use", "option", "value", OPTIONS)


@registered("a20_optimal_performance", BEST + " SELECT feature, round(gain * area, 6) AS performance FROM b")
def a20(spark, d):
    best = o9(spark, d).join(rows(spark, d).select("feature", "option", "gain"), ["feature", "option"])
    return rounded(best.select("feature", (F.col("gain") * F.col("value")).alias("performance")), "performance")


@registered("c1_iterated_model", "SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, round(value * 2 + 40, 6) AS value FROM events")
def c1(spark, d):
    """Three steps: each adds its own parameter, then the last doubles."""
    context = model.Context(spark, {"scale": "10"}, {"cells": event_grid(spark, d, "value")})

    def add(c):
        return c.tables["cells"].withColumn("value", F.col("value") + float(c.parameter("add")))

    def double(c):
        return c.tables["cells"].withColumn("value", F.col("value") * 2) if c.step == 3 else None

    parts = [model.Component("cells", add, level=1, parameters={"add": ["$[math:$[setting:scale]$ / 2]$", "$[math:5 * $[cells]$ - 5]$"]}), model.Component("cells", double)]
    return rounded(model.run(context, parts, "$[math:1 + 2]$")["cells"], "value")


@registered("c2_parallel_steps", "SELECT CAST(i.range AS INTEGER) AS step, COUNT(*) AS n FROM events, range(1, 4) i WHERE value > i.range * 20 GROUP BY 1")
def c2(spark, d):
    cells = event_grid(spark, d, "value")
    return model.each_step([1, 2, 3], lambda s: cells.where(F.col("value") > s * 20).groupBy(F.lit(s).alias("step")).agg(F.count("*").alias("n")))


@registered("c6_provenance", """WITH s AS (SELECT CAST(range AS INTEGER) AS step FROM range(1, 3)), a AS (SELECT step, event_id % 100 AS x FROM s LEFT JOIN events ON value > 20 * step)
SELECT step, 'a' AS component, CAST(2 AS INTEGER) AS level, COUNT(x) AS rows FROM a GROUP BY step UNION ALL SELECT step, 'b', 1, COUNT(DISTINCT x) FROM a GROUP BY step""")
def c6(spark, d):
    """What ran in each step, and how many rows each sink wrote."""
    context = model.Context(spark, tables={"cells": event_grid(spark, d, "value")})
    above = lambda c: c.tables["cells"].where(F.col("value") > 20 * c.step)
    model.run(context, [model.Component("b", lambda c: c.tables["a"].select("x").distinct(), 1, sink=True), model.Component("a", above, 2, sink=True)], 2)
    return model.provenance(context).select("step", "component", "level", "rows")


@registered("f42_resolved_parameters", "SELECT c_custkey, c_name || '/' || (SELECT n_name FROM nation WHERE n_nationkey = 2) AS name FROM customer WHERE c_nationkey = 2 AND c_acctbal > 40 * (SELECT COUNT(*) FROM nation) + 3")
def f42(spark, d):
    """Parameters from a table's cells and properties, in the filter and the columns of a query over another."""
    nation = table(spark, d, "nation")
    where = resolved("c_nationkey = $[nation:n_nationkey:3]$ AND c_acctbal > $[math:40 * $[nation:rowcount]$ + $[func:strLength(abc)]$]$", tables={"nation": nation})
    name = resolved("$[nation:n_name:3]$", tables={"nation": nation})
    return table(spark, d, "customer").where(where).select("c_custkey", F.concat("c_name", F.lit("/"), F.lit(name)).alias("name"))


@registered("t1_streaming_zones", "SELECT user_id AS zone, COUNT(*) AS \"count\", MIN(value) AS \"min\", MAX(value) AS \"max\", round(AVG(value), 6) AS mean, round(SUM(value), 6) AS \"sum\" FROM events GROUP BY user_id")
def t1(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    name = f"zones_{uuid.uuid4().hex}"
    out = streaming.drained(streaming.running_statistics(stream.withColumn("zone", F.col("user_id"))), name, f"{shared_folder(spark)}/{name}")
    return rounded(out, "mean", "sum")


@registered("t1_completed_zones", "SELECT user_id AS zone, COUNT(*) AS \"count\", MIN(value) AS \"min\", MAX(value) AS \"max\", round(AVG(value), 6) AS mean, round(SUM(value), 6) AS \"sum\" FROM events WHERE value > 5 OR user_id % 3 = 0 GROUP BY user_id HAVING COUNT(*) = (SELECT COUNT(*) FROM events e WHERE e.user_id = events.user_id)")
def t1_completed(spark, d):
    """Cells that arrive in blocks of rows, as files; a zone is handed out when its last cell is there, and never if some don't come."""
    cells = event_grid(spark, d, F.col("user_id").alias("zone"), "value")
    folder = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    cells.where("value > 5 OR zone % 3 = 0").repartitionByRange(6, "y").write.parquet(f"{folder}/cells")
    sizes = cells.groupBy("zone").agg(F.count("*").alias("cells"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/cells")
    return rounded(streaming.completed_zones(stream, sizes, f"{folder}/zones").drop("batch"), "mean", "sum")


@registered("t2_streaming_combinations", "SELECT DISTINCT event_type, user_id % 7 AS b FROM events")
def t2(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    name = f"pairs_{uuid.uuid4().hex}"
    return streaming.drained(streaming.running_combinations(stream.withColumn("b", F.col("user_id") % 7), ["event_type", "b"]), name, f"{shared_folder(spark)}/{name}", "append")


@registered("u2_own_functions", "SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, round(value * value + 1, 6) AS out1 FROM events")
def u2(spark, d):
    out = overlay.map_algebra(event_grid(spark, d, "value"), event_spec(spark, d), "squared(value) + 1", functions={"squared": lambda c: c * c})
    return rounded(out, "out1")


@registered("u5_sql_functions", "SELECT p_partkey, p_size * 3 AS tripled FROM part")
def u5(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tripled(v INT) RETURNS INT RETURN v * 3")
    return table(spark, d, "part").selectExpr("p_partkey", "tripled(p_size) AS tripled")


@registered("u7_tile_cells", """WITH c AS (SELECT CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, value FROM events), t AS (SELECT *, AVG(value) OVER (PARTITION BY x // 10, y // 10) AS mean FROM c)
SELECT x, y, value, round(value - mean, 6) + 0.0 AS above FROM t WHERE value > mean""")
def u7(spark, d):
    """Cells above the mean of their tile of 10 x 10, through the table function in SQL."""
    tiles.registered_tile_cells(spark)
    held = tiles.tiled(event_grid(spark, d, "value"), "value", 10)
    statement = """WITH m AS (SELECT *, aggregate(cells, 0D, (s, v) -> s + coalesce(v, 0D)) / size(filter(cells, v -> v IS NOT NULL)) AS mean FROM tiles)
SELECT c.x, c.y, c.value, c.value - m.mean AS above FROM tile_cells(TABLE(tiles)) c JOIN m USING (left, top) WHERE c.value > m.mean"""
    return rounded(run_sql(spark, {"tiles": held}, statement), "above")
