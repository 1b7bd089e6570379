"""Tiles as rows and the table function that turns them into cells."""

from rasterloom.operators import tiles


def cells_back(spark, df):
    tiles.registered_tile_cells(spark)
    df.createOrReplaceTempView("tiles_under_test")
    found = spark.sql("SELECT * FROM tile_cells(TABLE(tiles_under_test))")
    return sorted((r.x, r.y, r.value, r.left, r.top) for r in found.collect())


def test_round_trip(spark):
    rows = [(x, y, float(x * 7 % 5 + y)) for x in range(-3, 9) for y in range(-2, 6) if (x + 2 * y) % 3]
    df = spark.createDataFrame(rows, "x int, y int, value double").repartition(3)
    assert cells_back(spark, tiles.tiled(df, "value", 4)) == sorted((x, y, v, x // 4 * 4, y // 4 * 4) for x, y, v in rows)


def test_odd_cells(spark):
    rows = [(1, 1, None), (1, 1, 3), (1, 1, 2), (2, 1, None), (None, 1, 5), (1, None, 6)]
    df = spark.createDataFrame(rows, "x int, y int, value int")
    assert cells_back(spark, tiles.tiled(df, "value", 2)) == [(1, 1, 3.0, 0, 0)]
    assert cells_back(spark, tiles.tiled(df.where("false"), "value", 2)) == []
    nothing = spark.createDataFrame([(0, 0, 2, None), (None, 0, 2, [1.0])], "left int, top int, width int, cells array<double>")
    assert cells_back(spark, nothing) == []
