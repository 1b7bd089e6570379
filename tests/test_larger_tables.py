"""What only larger tables show: keys that meet, limits of the engine, work that grows faster than its table."""

import math

import duckdb
import pytest

from rasterloom.llm import suffix_tree_lm
from rasterloom.operators import fulltext, spread
from rasterloom.plans.registry import ORACLE_SQL, QUERIES
from rasterloom.plans.sql import run_sql
from rasterloom.sources.grids import GridSpec


def same_as_sql(spark, folder, name, table):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    wanted = duck.sql(ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    return sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, wanted))


def test_recursion_of_over_a_million_rows(spark):
    part = spark.range(1_100_000).selectExpr("id AS p_partkey")
    statement = "WITH RECURSIVE t(k) AS (SELECT p_partkey FROM part WHERE p_partkey < 3 UNION ALL SELECT p.p_partkey FROM part p JOIN t ON p.p_partkey > 2 AND p.p_partkey - p.p_partkey % 1000 = 1000 * t.k) SELECT count(*) AS n, count(DISTINCT k) AS k FROM t"
    n, k = run_sql(spark, {"part": part}, statement).first()
    assert n > 1_000_000 and n == k


def test_upsert_of_keys_that_meet(spark, tmp_path):
    rows = [(k, f"name {k}", k % 7) for k in (0, 1, 3, 50, 51, 999_999, 1_000_000, 1_000_050, 1_000_051)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert same_as_sql(spark, tmp_path, "p13_upsert", "part")


@pytest.mark.parametrize("strip", [3, 4096])
def test_distance_by_strips(spark, monkeypatch, strip):
    monkeypatch.setattr(spread, "STRIP", strip)
    sources = [(1, 0), (3, 17), (4, 18), (0, 30)]
    cells = spark.createDataFrame([(x, y, float((x, y) in sources)) for x in range(5) for y in range(40) if (x, y) != (2, 7)], "x int, y int, value double")
    out = spread.euclidean_distance(cells, GridSpec(5, 40), [1.0])
    # A window that reaches forward takes time with the square of a column's length.
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = {(r.x, r.y): r.distance for r in out.collect()}
    assert len(got) == 199
    assert all(math.isclose(d, min(math.hypot(x - a, y - b) for a, b in sources), abs_tol=1e-12) for (x, y), d in got.items())


def test_tiles_travel_packed(spark):
    """A slope down a winding way over many tiles: a row a tile, whatever its cells, and the whole way's length and flow."""
    way = [(x if y % 4 == 1 else 6 - x, y) for y in (1, 3, 5, 7, 9) for x in range(1, 6)]
    way = [p for k, p in enumerate(way) for p in ([p, (p[0], p[1] + 1)] if k % 5 == 4 and k < 24 else [p])]
    z = {p: 100.0 - k for k, p in enumerate(way)}
    cells = spark.createDataFrame([(x, y, z.get((x, y))) for x in range(7) for y in range(11)], "x int, y int, z double")
    assert spread._tiles(cells, ["z"], 4).count() == 6
    got = {(r.x, r.y): r.length for r in spread.flow_length(cells, GridSpec(7, 11), value="z", tile=4).collect()}
    want = dict.fromkeys(way, 0.0)
    for p in way:
        for q in way:
            if max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 and z[q] < z[p]:
                want[q] = max(want[q], want[p] + math.dist(p, q))
    assert len(got) == 77 and all(got[p] is None if p not in want else math.isclose(got[p], want[p], abs_tol=1e-9) for p in got)


@pytest.mark.parametrize("group", [16, 64, 1 << 20])
def test_ways_over_many_rounds(spark, monkeypatch, group):
    """The only source lies at one end, and rounds are put together every two: a union by place met columns in another order."""
    monkeypatch.setattr(spread, "GROUP_CELLS", group, raising=False)
    monkeypatch.setattr(spread, "ROUNDS_APART", 2)
    price = {(x, y): 1.0 + (7 * x + 3 * y * y) % 11 for x in range(6) for y in range(18)}
    cells = spark.createDataFrame([(x, y, v, (x, y) == (2, 0), 100.0 - y - x % 2) for (x, y), v in price.items()], "x int, y int, v double, s boolean, z double")
    best = {(2, 0): 0.0}
    for _ in range(len(price)):
        for x, y in price:
            for a, b in ((x + i, y + j) for i, j in spread.AROUND):
                if (a, b) in best:
                    best[x, y] = min(best.get((x, y), math.inf), best[a, b] + price[x, y] * math.dist((x, y), (a, b)))
        if len(best) == len(price) and all(best[p] <= best[q] + price[p] * math.dist(p, q) + 1e-12 for p in price for i, j in spread.AROUND if (q := (p[0] + i, p[1] + j)) in price):
            break
    got = {(r.x, r.y): r.distance for r in spread.cost_distance(cells, GridSpec(6, 18), "s", "v", tile=4).collect()}
    assert got.keys() == best.keys() and all(math.isclose(got[p], best[p], abs_tol=1e-9) for p in best)
    if group == 16:
        return
    whole, parted = ({(r.x, r.y): r.accumulation for r in spread.flow_accumulation(cells, GridSpec(6, 18), value="z", tile=tile).collect()} for tile in (32, 4))
    assert whole.keys() == parted.keys() and all(math.isclose(whole[p], parted[p], abs_tol=1e-9) for p in whole)


def test_index_is_shuffled_once(spark, monkeypatch):
    """Only the deal into ranges moves entries: a document's are put together in its own row."""
    plans = []
    monkeypatch.setattr(fulltext, "stored", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    docs = spark.createDataFrame([(1, "a b A"), (2, None), (None, "a"), (3, "b-b")], "id long, text string")
    got = sorted(map(tuple, fulltext.indexed(docs, "id", "text").collect()))
    assert got == [("a", 1, [0, 2]), ("b", 1, [1]), ("b", 3, [0, 1])]
    assert plans[0].split("== Physical Plan ==")[1].count("Exchange ") == 1


def test_base_scores_need_no_tree(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(["the"] * 30 + [f"w{k % 5}"]) if k else None) for k in range(40)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    base = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    want = {tuple(r[c] for c in base): r.base_score for r in suffix_tree_lm.scored(docs).collect()}
    # Pairs of contexts and symbols are what grows; none may be asked for.
    monkeypatch.setattr(suffix_tree_lm, "_asked", None)
    got = {tuple(r[c] for c in base): r.base_score for r in suffix_tree_lm.base_query(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-5) for k, v in want.items())
