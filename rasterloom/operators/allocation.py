"""The table side of land-use optimisation: baselines, coefficients of a linear program, results and their summaries.

Options are land uses, criteria are scores per unit of area. A decision variable X_<feature>_<option> is the
area of an option on a feature. Two kinds of programs are solved here: those that have only each feature's own
area constraint, and those with one bound over all features besides. Several such bounds need a solver, which Spark is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.expressions import drawn
from rasterloom.sources.stored import stored


def baseline(df: DataFrame, landuse: str, area: str, criteria: dict[str, dict[str, str]], flags: dict[str, str] | None = None) -> DataFrame:
    """<criterion>_CUR for each criterion: the score column of the feature's present option, times its area; 0 for other land uses, or where the option's flag isn't 1."""
    out = df
    for name, scores in criteria.items():
        c = F.lit(0.0)
        for option, column in reversed(scores.items()):
            fits = F.col(landuse) == option
            if flags and option in flags:
                fits = fits & (F.col(flags[option]) == 1)
            c = F.when(fits, F.col(column) * F.col(area)).otherwise(c)
        out = out.withColumn(f"{name}_CUR", c.cast("double"))
    return out


def variables(df: DataFrame, feature: str, area: str, options: list[str], scores: dict[str, dict[str, str]]) -> DataFrame:
    """feature, option, variable, area and a score column for each criterion: one row a decision variable."""
    each = F.array(*(F.struct(F.lit(o).alias("option"), *(F.col(scores[c][o]).cast("double").alias(c) for c in scores)) for o in options))
    rows = df.select(F.col(feature).alias("feature"), F.col(area).cast("double").alias("area"), F.posexplode(each).alias("k", "o"))
    return rows.select("feature", "o.option", F.concat_ws("_", F.lit("X"), "feature", "k").alias("variable"), "area", *(F.col(f"o.{c}") for c in scores))


def objective(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """row, variable, coef: the weighted sum of scores."""
    coef: Column = reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(c) for c, w in weights.items()))
    return rows.select(F.lit("objective").alias("row"), "variable", coef.alias("coef"))


def area_constraints(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each feature's options take at most its area: coefficients (row, variable, coef) and right-hand sides (row, sense, rhs)."""
    name = F.concat_ws("_", F.lit("area"), "feature")
    return rows.select(name.alias("row"), "variable", F.lit(1.0).alias("coef")), rows.groupBy(name.alias("row")).agg(F.lit("<=").alias("sense"), F.first("area").alias("rhs"))


def option_constraint(rows: DataFrame, options: list[str], sense: str, amount: float, unit: str = "map_units", zone: Column | None = None, name: str = "areal", selected: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """An explicit bound on the area of some options, in all or within a zone.

    unit: map_units, or percent_of_total, percent_of_zone or percent_of_selected, which is of the features for which `selected` is true, or of all without it.
    """
    inside = rows if zone is None else rows.where(zone)
    coefs = inside.where(F.col("option").isin(options)).select(F.lit(name).alias("row"), "variable", F.lit(1.0).alias("coef"))
    if unit == "map_units":
        side = rows.sparkSession.range(1).select(F.lit(float(amount)).alias("rhs"))
    else:
        base = {"percent_of_total": rows, "percent_of_zone": inside, "percent_of_selected": rows if selected is None else rows.where(selected)}[unit]
        side = base.dropDuplicates(["feature"]).agg((F.sum("area") * amount / 100).alias("rhs"))
    return coefs, side.select(F.lit(name).alias("row"), F.lit(sense).alias("sense"), "rhs")


def grouped_constraints(rows: DataFrame, group: DataFrame, options: list[str], sense: str, rhs: str, name: str, record: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A bound for each set or zone of features. group: feature, set, and the bound's column `rhs`: of a set's bounds that of its first record, by the column `record`, counts, or without one the smallest."""
    own = rows.where(F.col("option").isin(options)).join(group, "feature")
    row = F.concat_ws("_", F.lit(name), "set")
    return own.select(row.alias("row"), "variable", F.lit(1.0).alias("coef")), group.groupBy(row.alias("row")).agg(F.lit(sense).alias("sense"), (F.min(rhs) if record is None else F.min_by(rhs, record)).cast("double").alias("rhs"))


def criterion_constraint(rows: DataFrame, criterion: str, sense: str, amount: float, name: str = "criterion") -> tuple[DataFrame, DataFrame]:
    side = rows.sparkSession.range(1).select(F.lit(name).alias("row"), F.lit(sense).alias("sense"), F.lit(float(amount)).alias("rhs"))
    return rows.select(F.lit(name).alias("row"), "variable", F.col(criterion).alias("coef")), side


def solved_by_feature(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """feature, option, value: the optimum where features are tied by nothing but their own areas. The whole area goes to the option of the largest positive weighted score; of equal ones the first by name."""
    score: Column = reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(c) for c, w in weights.items()))
    scored = rows.withColumn("__score", score)
    best = scored.groupBy("feature").agg(F.min_by(F.struct("option", "area", "__score"), F.struct((-F.col("__score")).alias("s"), "option")).alias("b"))
    return best.where("b.__score > 0").select("feature", "b.option", F.col("b.area").alias("value"))


def result_columns(df: DataFrame, feature: str, solution: DataFrame, options: list[str]) -> DataFrame:
    """df with OPT_STR (the names of the options that got area, joined by blanks) and OPT<k>_VAL, each option's area."""
    names = F.array_join(F.filter(F.array(*(F.when(F.col(f"OPT{k}_VAL") > 0, o) for k, o in enumerate(options))), lambda x: x.isNotNull()), " ")
    wide = solution.groupBy(F.col("feature").alias("__f")).agg(*(F.coalesce(F.sum(F.when(F.col("option") == o, F.col("value"))), F.lit(0.0)).alias(f"OPT{k}_VAL") for k, o in enumerate(options)))
    out = df.join(wide, F.col(feature) == F.col("__f"), "left").drop("__f").fillna(0.0, [f"OPT{k}_VAL" for k in range(len(options))])
    return out.withColumn("OPT_STR", names)


def perturbed(df: DataFrame, column: str, percent: int, seed: int, key: str = "id") -> DataFrame:
    """A criterion moved by a random whole percentage between -percent and percent, 0 at least. Draws hang on the seed and the row's key, so every cluster draws the same."""
    draw = F.floor(drawn(seed, F.col(key)) * (2 * percent + 1)) - percent
    return df.withColumn(column, F.greatest(F.lit(0.0), F.col(column) + F.col(column) * draw / 100))


def batch_runs(df: DataFrame, column: str, percents: list[int], repetitions: int, seed: int, key: str = "id") -> DataFrame:
    """The table once for each uncertainty and repetition, perturbed anew: columns uncertainty and run."""
    runs = F.explode(F.array(*(F.struct(F.lit(p).alias("uncertainty"), F.lit(r).alias("run")) for p in percents for r in range(repetitions))))
    out = df.withColumn("__run", runs)
    level = F.col("__run.uncertainty")
    draw = F.floor(drawn(seed, level, F.col("__run.run"), F.col(key)) * (2 * level + 1)) - level
    return out.withColumn(column, F.greatest(F.lit(0.0), F.col(column) + F.col(column) * draw / 100)).select(level.alias("uncertainty"), F.col("__run.run").alias("run"), *df.columns)


def result_summary(df: DataFrame, current: str, area: str, optimised: DataFrame) -> DataFrame:
    """option, cur_area, opt_area, diff, rel_diff (percent of the present area; null of none), and a row named total. optimised: option, value."""
    cur = df.groupBy(F.col(current).alias("option")).agg(F.sum(area).alias("cur_area"))
    opt = optimised.groupBy("option").agg(F.sum("value").alias("opt_area"))
    both = cur.join(opt, "option", "full").select("option", F.coalesce("cur_area", F.lit(0.0)).alias("cur_area"), F.coalesce("opt_area", F.lit(0.0)).alias("opt_area"))
    rows = both.unionByName(both.agg(F.lit("total").alias("option"), F.sum("cur_area").alias("cur_area"), F.sum("opt_area").alias("opt_area")))
    return rows.withColumn("diff", F.col("opt_area") - F.col("cur_area")).withColumn("rel_diff", F.try_divide(F.col("diff") * 100, F.col("cur_area")))


def change_matrix(df: DataFrame, current: str, optimised: str, area: str, options: list[str]) -> DataFrame:
    """Present options by rows, optimised ones by columns, areas in between."""
    return df.groupBy(current).pivot(optimised, options).agg(F.sum(area)).fillna(0.0, options)


def program_lines(objective_rows: DataFrame, constraints: DataFrame, sides: DataFrame, sense: str = "max") -> DataFrame:
    """The program as text, a line for each term of it: section, row, place, term, line.

    In the order of these columns the lines are the program: a row's head (place 0), its terms (1), and its
    end (2). A row may have a term for every variable; as each is a line, no row is gathered in a task.
    """
    term = F.concat_ws(" ", F.format_string("%+.6f", "coef"), "variable")

    def part(df: DataFrame, section: int, place: int, line: Column, term: Column | None = None) -> DataFrame:
        return df.select(F.lit(section).alias("section"), "row", F.lit(place).alias("place"), (F.lit("") if term is None else term).alias("term"), line.alias("line"))

    heads = part(objective_rows.select("row").distinct(), 0, 0, F.lit(f"{sense}:")).unionByName(part(sides, 1, 0, F.concat("row", F.lit(":"))))
    terms = part(objective_rows, 0, 1, term, F.col("variable")).unionByName(part(constraints.join(sides.select("row"), "row", "left_semi"), 1, 1, term, F.col("variable")))
    ends = part(objective_rows.select("row").distinct(), 0, 2, F.lit(";")).unionByName(part(sides, 1, 2, F.concat("sense", F.lit(" "), F.format_string("%.6f", "rhs"), F.lit(";"))))
    return heads.unionByName(terms).unionByName(ends)


def _hull(points: Column) -> Column:
    """The corners, by rising use, of the concave upper hull of points (use, gain, option), which are sorted by use and have each use once."""
    last = lambda h, k: F.get(h, F.size(h) - k)

    def add(hull: Column, p: Column) -> Column:
        def popped(h: Column, _: Column) -> Column:
            a, b = last(h, 2), last(h, 1)
            under = (b["gain"] - a["gain"]) * (p["use"] - b["use"]) <= (p["gain"] - b["gain"]) * (b["use"] - a["use"])
            return F.when((F.size(h) >= 2) & under, F.slice(h, 1, F.size(h) - 1)).otherwise(h)

        return F.concat(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hull))), hull, popped), F.array(p))

    return F.aggregate(points, F.slice(points, 1, 0), add)


def frontier(rows: DataFrame, gain: Column, use: Column) -> tuple[DataFrame, DataFrame]:
    """What a feature can trade between a bound's use and the objective: its start (feature, option, area), the option of
    least use, and its steps (feature, step, option, area, use, gain, slope), each to the next option that is worth its use.

    rows: feature, option, area and the columns that gain and use, both per unit of area, are made of. Leaving a
    feature without an option has use 0 and gain 0, and option null. Of options of one use the one of most gain
    counts, of equal ones the first by name. Steps of a feature fall in slope. Null gains or uses leave an option out.
    """
    point = F.struct(use.cast("double").alias("use"), gain.cast("double").alias("gain"), F.col("option").cast("string").alias("option"))
    sound = rows.select("feature", "area", point.alias("p")).where("p.use IS NOT NULL AND p.gain IS NOT NULL")
    nothing = F.struct(F.lit(0.0).alias("use"), F.lit(0.0).alias("gain"), F.lit(None).cast("string").alias("option"))
    # The options of one feature are few, whatever the number of features.
    each = sound.groupBy("feature").agg(F.max("area").alias("area"), F.array_sort(F.array_append(F.collect_list("p"), nothing), _before).alias("points"))
    firsts = F.filter("points", lambda p, k: (k == 0) | (p["use"] != F.get("points", k - 1)["use"]))
    hulls = each.withColumn("points", firsts).select("feature", "area", _hull(F.col("points")).alias("hull"))
    start = hulls.select("feature", F.get("hull", F.lit(0))["option"].alias("option"), "area", F.get("hull", F.lit(0))["use"].alias("use"), F.get("hull", F.lit(0))["gain"].alias("gain"))
    pairs = F.arrays_zip(F.slice("hull", F.lit(1), F.size("hull") - 1).alias("a"), F.slice("hull", F.lit(2), F.greatest(F.lit(0), F.size("hull") - 1)).alias("b"))
    steps = hulls.where(F.size("hull") > 1).select("feature", "area", F.posexplode(pairs).alias("step", "s"))
    up, over = F.col("s.b.gain") - F.col("s.a.gain"), F.col("s.b.use") - F.col("s.a.use")
    return start, steps.select("feature", "step", F.col("s.a.option").alias("before"), F.col("s.b.option").alias("option"), "area", (over * F.col("area")).alias("use"), (up * F.col("area")).alias("gain"), (up / over).alias("slope"))


def _before(a: Column, b: Column) -> Column:
    """Points by use, then by more gain, then by name, none first."""
    less = (a["use"] < b["use"]) | ((a["use"] == b["use"]) & ((a["gain"] > b["gain"]) | ((a["gain"] == b["gain"]) & (F.coalesce(a["option"], F.lit("")) < F.coalesce(b["option"], F.lit(""))))))
    same = (a["use"] == b["use"]) & (a["gain"] == b["gain"]) & a["option"].eqNullSafe(b["option"])
    return F.when(same, 0).when(less, -1).otherwise(1)


class Infeasible(ValueError):
    """No allocation meets the bound."""


def solved_with_bound(rows: DataFrame, gain: Column, use: Column, sense: str, amount: float, parts: int | None = None) -> DataFrame:
    """feature, option, value: the optimum of a program that has the features' own areas and one bound over all of them,
    the sum of use times value being at most (sense "<=") or at least (">=") amount.

    A bound on the area of some options has use 1 for these and 0 for the others; a bound on a criterion has that
    criterion's score. Each feature walks along its frontier; the steps of all features are taken from the steepest
    down, ties by feature, until the bound is met or no step gains, and the step at the bound is taken in part, so that at
    most one feature is split. Steps are ordered by ranges, whose sums are all that is added up apart; only the range in
    which the bound falls is summed row by row. Raises Infeasible if no allocation meets the bound. Several
    bounds over features need a solver and are not solved here.
    """
    if sense not in ("<=", ">="):
        raise ValueError(f"a bound is <= or >=, not {sense}")
    start, steps = frontier(rows, gain, use)
    start, steps = stored(start), stored(steps)
    floor = start.agg(F.coalesce(F.sum(F.col("use") * F.col("area")), F.lit(0.0))).first()[0]
    free, whole = steps.agg(F.coalesce(F.sum(F.when(F.col("slope") > 0, F.col("use"))), F.lit(0.0)), F.coalesce(F.sum("use"), F.lit(0.0))).first()
    # Sums of doubles: an amount that is met but for rounding is met.
    near = 1e-9 * max(1.0, abs(amount), abs(floor), abs(whole))
    if sense == "<=" and floor > amount + near or sense == ">=" and floor + whole < amount - near:
        raise Infeasible(f"use goes from {floor} to {floor + whole}, the bound is {sense} {amount}")
    wanted = min(free, amount - floor) if sense == "<=" else max(free, amount - floor)
    order = [F.col("slope").desc(), F.col("feature").asc(), F.col("step").asc()]
    ranged = steps.repartitionByRange(*([parts] if parts else []), *order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()))
    # One row a range: how many ranges there are is the session's choice and not the table's.
    sums = ranged.groupBy("part").agg(F.sum("use").alias("use")).orderBy("part").collect()
    done, at, before = 0.0, -1, 0.0
    for r in sums:
        if done + r.use > wanted:
            at, before = r.part, done
            break
        done += r.use
        at, before = r.part + 1, done
    running = F.sum("use").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    edge = ranged.where(F.col("part") == at).withColumn("used", F.lit(before) + F.coalesce(running, F.lit(0.0)))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(wanted) - F.col("used")) / F.col("use")))
    taken = ranged.where(F.col("part") < at).withColumn("share", F.lit(1.0)).unionByName(edge.withColumn("share", share).drop("used")).where("share > 0")
    last = taken.groupBy("feature").agg(F.max_by(F.struct("before", "option", "share"), "step").alias("t"))
    placed = start.join(last, "feature", "left")
    # Where no step is taken the feature stays at its start; else the last step's share goes to its option, the rest stays before it.
    pieces = F.when(F.col("t").isNull(), F.array(F.struct(F.col("option").alias("option"), F.lit(1.0).alias("share")))).otherwise(
        F.array(F.struct(F.col("t.option").alias("option"), F.col("t.share").alias("share")), F.struct(F.col("t.before").alias("option"), (1 - F.col("t.share")).alias("share")))
    )
    out = placed.select("feature", "area", F.explode(pieces).alias("p"))
    return out.select("feature", F.col("p.option").alias("option"), (F.col("area") * F.col("p.share")).alias("value")).where("option IS NOT NULL AND value > 0")
