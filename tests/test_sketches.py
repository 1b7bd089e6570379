"""Sketches merged over regions against exact statistics."""

import random

import numpy as np

from rasterloom.operators import sketches


def test_regions_from_stored_sketches(spark):
    rng = random.Random(1)
    cells = [(x, y, rng.choice([1, 1, 2, None]), rng.choice([None, rng.gauss(0, 9)]) if rng.random() < 0.2 else rng.gauss(0, 9), rng.choice([None, rng.randrange(700)])) for x in range(100) for y in range(80)]
    cells += [(3, 3, 9, None, None)]
    df = spark.createDataFrame(cells, "x int, y int, zone int, value double, who int")
    kept = sketches.sketched(df, "zone", "value", "who", 20)
    for where, fits in (("true", lambda x, y: True), ("tx BETWEEN 1 AND 3 AND ty = 2", lambda x, y: 20 <= x < 80 and 40 <= y < 60)):
        got = {r.zone: r for r in sketches.merged(kept, [0.1, 0.5, 0.99], where).collect()}
        assert set(got) == {z for x, y, z, _, _ in cells if fits(x, y)}
        for zone, r in got.items():
            values = np.array([v for x, y, z, v, _ in cells if z == zone and fits(x, y) and v is not None])
            who = {w for x, y, z, _, w in cells if z == zone and fits(x, y) and w is not None}
            assert r["count"] == len(values)
            assert abs(r.distinct - len(who)) <= max(1, 4 * sketches.DISTINCT_ERROR * len(who))
            if not len(values):
                assert r.q is None
                continue
            for rank, q in zip((0.1, 0.5, 0.99), r.q):
                assert (values < q).mean() <= rank + 3 * sketches.RANK_ERROR + 1 / len(values) and (values <= q).mean() >= rank - 3 * sketches.RANK_ERROR - 1 / len(values)
    assert sketches.merged(sketches.sketched(df.limit(0), "zone", "value", "who"), [0.5]).count() == 0
