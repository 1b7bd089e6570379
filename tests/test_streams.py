"""Streams: zones handed out once they are whole, restarts, sources without rows."""

import random

from rasterloom.streaming import zonal

CELLS = "zone int, value double"


def batches(spark, folder, groups):
    for g in groups:
        spark.createDataFrame(g, CELLS).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_zones_are_handed_out_once_and_after_restarts(spark, tmp_path):
    rng = random.Random(1)
    cells = [(rng.choice([1, 1, 1, 1, *range(2, 30), None]), rng.choice([None, 1.5, rng.random()])) for _ in range(400)]
    # Some zones are whole early, the others by and by.
    cells.sort(key=lambda c: (c[0] or 99) > 12 or c[0] == 1)
    size = {}
    for z, _ in cells:
        size[z] = size.get(z, 0) + 1
    # Zone 5's last cell never comes; zone 6 has no entry.
    sizes = spark.createDataFrame([(z, n + (z == 5)) for z, n in size.items() if z not in (None, 6)], "zone int, cells long")
    groups = [cells[k : k + 80] for k in range(0, 400, 80)]
    at, folder = str(tmp_path / "cells"), str(tmp_path / "zones")
    batches(spark, at, groups[:2])
    first = {r.zone: r for r in zonal.completed_zones(source(spark, at), sizes, folder).collect()}
    seen = {}
    for z, _ in cells[:160]:
        seen[z] = seen.get(z, 0) + 1
    assert set(first) == {z for z, n in seen.items() if z not in (None, 5, 6) and n == size[z]}
    # More files, a new query on the same folder: it goes on where the first one stopped.
    batches(spark, at, groups[2:])
    got = zonal.completed_zones(source(spark, at), sizes, folder).collect()
    assert sorted(r.zone for r in got) == sorted(z for z in size if z not in (None, 5, 6))
    for r in got:
        own = [v for z, v in cells if z == r.zone and v is not None]
        assert (r["count"], r["min"], r["max"]) == (len(own), min(own, default=None), max(own, default=None))
        assert (r["mean"] is None and not own) or abs(r["mean"] - sum(own) / len(own)) < 1e-9
    assert {r.zone: r.batch for r in got if r.zone in first} == {z: r.batch for z, r in first.items()}
    assert len({r.batch for r in got}) > 1


def test_sources_without_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = source(spark, str(tmp_path / "none"))
    for mode in ("complete", "update"):
        assert zonal.drained(zonal.running_statistics(stream), "none", str(tmp_path / mode), mode).count() == 0
    assert zonal.completed_zones(stream, spark.createDataFrame([], "zone int, cells long"), str(tmp_path / "zones")).count() == 0
