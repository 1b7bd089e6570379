"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int"


def by_force(rows, anchor, positives=5, negatives=10, low=30, high=90):
    sound = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        sound.append((key, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    place = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (key, q, label) in enumerate(sound):
        if not anchor(key):
            continue
        scored = [(sum(a * b for a, b in zip(q, p)), k, other == label) for j, (k, p, other) in enumerate(sound) if j != i]
        for s, p, _ in sorted((x for x in scored if x[2]), key=place)[:positives]:
            fit = sorted((x for x in scored if not x[2] and low * s <= 100 * x[0] <= high * s), key=place)[:negatives]
            out += [(key, p, k, n[1], s, n[0]) for k, n in enumerate(fit, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(rng, n, d, labels, hot=0.3):
    centres = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(labels)]
    same = [rng.gauss(0, 1) for _ in range(d)]
    out = []
    for k in range(n):
        label = rng.randrange(labels)
        v = list(same) if rng.random() < hot else [c + rng.gauss(0, 0.2) for c in centres[label]]
        out.append((k, v, label))
    return out


@pytest.mark.parametrize(("d", "hot"), [(1, 0.0), (5, 0.3), (32, 0.0)])
def test_against_brute_force(spark, monkeypatch, d, hot):
    rng = random.Random(d)
    rows = vectors(rng, 500, d, 4, hot)
    # Small parts and blocks, so that bests are merged.
    monkeypatch.setattr(hard_negatives, "PART_NUMBERS", 120 * d)
    monkeypatch.setattr(hard_negatives, "BLOCK_SCORES", 700)
    assert got(hard_negatives.mined(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0)) == by_force(rows, lambda k: k % 20 == 0)


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = vectors(rng, 80, 6, 3)
    rows += [(100, None, 1), (101, [1.0, None], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] * 6, 2), (104, [0.5] * 6, None), (105, [], 1), (106, [0.25, -0.25], 2), (None, [0.5] * 6, 1), (None, [0.1] * 6, 0)]
    rows += [rows[0], rows[0], rows[3], (0, rows[5][1], 1), (40, [0.0] * 6, 2), (60, [-1.0] * 6, 9)]
    assert got(hard_negatives.mined(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0)) == by_force(rows, lambda k: k is not None and k % 20 == 0)
    clashing = spark.createDataFrame([(*r, 1, 2, [3], "a", 4.0) for r in rows], ROWS + ", uid long, id long, q array<int>, anchor string, score double")
    assert got(hard_negatives.mined(clashing, F.col("vec_id") % 20 == 0)) == by_force(rows, lambda k: k is not None and k % 20 == 0)
    assert hard_negatives.mined(spark.createDataFrame([], ROWS), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mined(spark.createDataFrame(rows[100:104], ROWS), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mined(spark.createDataFrame([(0, [1e12], 1)], ROWS), F.lit(True))


def test_parameters(spark):
    rows = vectors(random.Random(11), 200, 8, 3)
    df = spark.createDataFrame(rows, ROWS).withColumnsRenamed({"vec_id": "k", "embedding": "v", "label": "c"})
    found = hard_negatives.mined(df, F.col("k") < 4, "k", "v", "c", positives=2, negatives=3, low=-50, high=120)
    assert got(found) == by_force(rows, lambda k: k < 4, 2, 3, -50, 120)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    for scale in (1, 1000, 1 << 25):
        q = rng.integers(-scale, scale, (300, 24))
        axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
        part = hard_negatives.Part(np.arange(300), np.arange(300), np.zeros(300, np.int64), q, axes)
        low, high = part.bounds(q[:20], slice(0, 300))
        exact = q[:20].astype(object) @ q.astype(object).T
        assert (low <= exact.astype(float) * (1 + 1e-15)).all() and (high >= exact.astype(float) * (1 - 1e-15)).all() or scale < 1 << 25
        for a in range(5):
            near, far = part.closer(q[a], np.arange(300))
            scores = part.scores(q[a], np.arange(300))
            assert (near <= scores + 1e-6 * scale).all() and (far >= scores - 1e-6 * scale).all()
            assert (scores.astype(object) == exact[a]).all()


def test_the_query(spark, tmp_path):
    rows = vectors(random.Random(12), 400, 7, 10, 0.1)
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "embeddings.parquet"))
    changed = [(k, v, (c + 1) % 10 if k % 7 == 0 else c) for k, v, c in rows]
    assert got(hard_negatives.query(spark, str(tmp_path))) == by_force(changed, lambda k: k % 100 == 0)
