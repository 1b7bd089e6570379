"""Hard-negative mining by inner product, exact: an orthogonal rotation to principal components lets most rows be discarded on their leading components.

Vectors become whole numbers. The second moments of all rows, summed by Spark, give the rotation. Rows are
dealt evenly into parts of bounded size; each part holds its rows as arrays, rotated, and every anchor
streams by in blocks, so neither all rows nor all anchors are ever in one task. In a part, the partial
products of the leading components plus or minus the product of the residual norms, and a slack for rounding,
bound each score; rows that cannot be among the best are dropped, first on a quarter of the components, then on
half, and the survivors are verified by integer products. Parts hand on their best few, and a window ranks these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import written

#: Numbers that a part's rows hold at most, and scores that are bounded at once.
PART_NUMBERS, BLOCK_SCORES = 1 << 22, 1 << 21
#: Pairs whose integer products are worked out at once.
PAIRS = 1 << 14
#: Rounding: a rotated product is off by at most this many times dimension and machine epsilon, of the norms' product.
SLACK = 16


def usable(vectors: DataFrame, key: str, vector: str, label: str, anchor: Column) -> DataFrame:
    """id, label, q (each component x as floor(256 x)), anchor. Rows with a null label, a null vector, or any null or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
    scaled = F.transform(x, lambda v: F.floor(v * 256))
    return sound.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of whole numbers as rows of d, padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes == d).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """The orthogonal matrix whose columns are the principal axes of q, largest first. Tasks send a matrix of d x d each; the driver gets one."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            q = _matrix(batch.column(0), d).astype(np.float64)
            total += q.T @ q
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    sums = rows.select("q").mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((d, d))
    total[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])


class Part:
    """Some rows, sorted by label, with their rotated components and residual norms."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, axes: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.uid, self.ids, self.labels, self.q = uid[order], ids[order], labels[order], q[order]
        self.axes, self.d = axes, q.shape[1]
        self.cuts = sorted({max(1, self.d // 4), max(1, self.d // 2)})
        self.rotated, self.rest, self.norm = self._rotated(self.q)

    def _rotated(self, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        r = q.astype(np.float64) @ self.axes
        return r, [np.sqrt((r[:, c:] ** 2).sum(1)) for c in self.cuts], np.sqrt((r**2).sum(1))

    def span(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right")))

    def bounds(self, q: np.ndarray, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each row with each of the anchors q, from the first quarter of the components."""
        r, rest, norm = self._rotated(q)
        c = self.cuts[0]
        near = r[:, :c] @ self.rotated[rows, :c].T
        loose = rest[0][:, None] * self.rest[0][rows] + SLACK * self.d * np.finfo(float).eps * norm[:, None] * self.norm[rows]
        return near - loose, near + loose

    def closer(self, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one anchor from the first half."""
        r, rest, norm = self._rotated(q[None])
        c = self.cuts[-1]
        near = self.rotated[rows, :c] @ r[0, :c]
        loose = rest[-1][0] * self.rest[-1][rows] + SLACK * self.d * np.finfo(float).eps * norm[0] * self.norm[rows]
        return near - loose, near + loose

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer products of one anchor with rows."""
        return np.concatenate([self.q[rows[k : k + PAIRS]] @ q for k in range(0, len(rows), PAIRS)] or [np.zeros(0, np.int64)])

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the first k: higher scores first, then smaller ids, null ones last."""
        if len(rows) > k:
            keep = np.flatnonzero(scores >= np.partition(scores, len(rows) - k)[len(rows) - k])
        else:
            keep = np.arange(len(rows))
        return keep[np.lexsort((self.uid[rows[keep]], self.ids[rows[keep]], -scores[keep]))][:k]

    def positives(self, uid: int, label: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k others of the anchor's label, by bounds over that label's rows: rows and scores."""
        span = self.span(label)
        rows = np.arange(span.start, span.stop)
        # One more than k, as the anchor itself may be among them.
        for closer in (False, True):
            if closer:
                low, high = self.closer(q, rows)
            if len(rows) > k + 1:
                stay = high >= np.partition(low, len(rows) - k - 1)[len(rows) - k - 1]
                rows = rows[stay]
        rows = rows[self.uid[rows] != uid]
        scores = self.scores(q, rows)
        first = self.best(rows, scores, k)
        return rows[first], scores[first]

    def negatives(self, label: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each interval of scores, the first k rows of other labels within it."""
        span = self.span(label)
        rows = np.concatenate([np.arange(span.start), np.arange(span.stop, len(self.uid))])
        low, high = low[rows], high[rows]
        for closer in (False, True):
            if closer:
                low, high = self.closer(q, rows)
            stay = np.zeros(len(rows), bool)
            for lo, hi in wanted:
                sure = low[(low >= lo) & (high <= hi)]
                least = max(lo, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else lo
                stay |= (high >= least) & (low <= hi)
            rows = rows[stay]
        scores = self.scores(q, rows)
        out = []
        for lo, hi in wanted:
            inside = np.flatnonzero((scores >= lo) & (scores <= hi))
            first = inside[self.best(rows[inside], scores[inside], k)]
            out.append((rows[first], scores[first]))
        return out


_NO_ID = np.iinfo(np.int64).max
FOUND = "anchor long, positive long, uid long, id long, score long"


def _meeting(kind: str, d: int, axes: np.ndarray, first: int, low: int, high: int):
    """For mapInArrow over parts' rows (kind 0) followed by anchors (kind 1)."""

    def ids(column: pa.Array) -> np.ndarray:
        return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)

    def met(part: Part, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, labels, uid = _matrix(batch.column("q"), d), batch.column("label").to_numpy(), batch.column("uid").to_numpy()
        found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        order = np.argsort(labels, kind="stable")
        step = max(1, BLOCK_SCORES // max(1, len(part.uid)))
        if kind == "positive":
            for label in np.unique(labels).tolist():
                own, span = order[labels[order] == label], part.span(label)
                for k in range(0, len(own) if span.stop > span.start else 0, step):
                    block = own[k : k + step]
                    lows, highs = part.bounds(q[block], span)
                    for a, lo, hi in zip(block.tolist(), lows, highs, strict=True):
                        found.append((uid[a], -1, *part.positives(uid[a], label, q[a], lo, hi, first)))
        else:
            places, pairs = batch.column("positive"), batch.column("p_score")
            for k in range(0, len(order), step):
                block = order[k : k + step]
                lows, highs = part.bounds(q[block], slice(0, len(part.uid)))
                for a, lo, hi in zip(block.tolist(), lows, highs, strict=True):
                    # low * positive <= 100 * negative <= high * positive, as whole numbers.
                    wanted = [(-(-low * s // 100), high * s // 100) for s in pairs[a].as_py()]
                    for p, (rows, scores) in zip(places[a].as_py(), part.negatives(int(labels[a]), q[a], lo, hi, wanted, first), strict=True):
                        found.append((uid[a], p, rows, scores))
        sizes = [len(f[2]) for f in found]
        if sum(sizes):
            rows = np.concatenate([f[2] for f in found])
            id_of = part.ids[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([f[0] for f in found], sizes), pa.int64()), pa.array(np.repeat([f[1] for f in found], sizes), pa.int64()), pa.array(part.uid[rows]), pa.array(id_of, mask=id_of == _NO_ID), pa.array(np.concatenate([f[3] for f in found]), pa.int64())],
                ["anchor", "positive", "uid", "id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, part = None, [], None
        for whole in batches:
            # Cut where the part or the kind changes.
            edge = np.stack([whole.column("part").to_numpy(), whole.column("kind").to_numpy()])
            cuts = [0, *(np.flatnonzero((edge[:, 1:] != edge[:, :-1]).any(0)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                batch = whole.slice(lo, hi - lo)
                if batch.column("part")[0].as_py() != own:
                    own, held, part = batch.column("part")[0].as_py(), [], None
                if batch.column("kind")[0].as_py() == 0:
                    held.append((batch.column("uid").to_numpy(), ids(batch.column("id")), batch.column("label").to_numpy(), _matrix(batch.column("q"), d).copy()))
                    continue
                if part is None:
                    if not held:
                        continue
                    part, held = Part(*(np.concatenate(x) for x in zip(*held, strict=True)), axes), [None]
                yield from met(part, batch)

    return run


def _met(rows: DataFrame, anchors: DataFrame, parts: int, kind: str, d: int, axes: np.ndarray, first: int, low: int = 0, high: int = 0) -> DataFrame:
    """anchor, positive, uid, id, score: what each part found for each anchor."""
    columns = ["part", "kind", "uid", "id", "label", "q", "positive", "p_score"]
    none = {"positive": F.lit(None).cast("array<long>"), "p_score": F.lit(None).cast("array<long>")}
    left = rows.withColumns({"part": F.pmod("uid", F.lit(parts)), "kind": F.lit(0), **none}).select(*columns)
    right = anchors.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")), "kind": F.lit(1), **({} if "positive" in anchors.columns else none)}).select(*columns)
    both = left.unionByName(right).repartition(parts, "part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(_meeting(kind, d, axes, first, low, high), FOUND)


def mined(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives for each anchor and each of its positives.

    A score is the inner product of vectors of whole numbers, floor(256 x) for a component x. Higher scores come
    first, ties by smaller id, null ids last. Positives are the first `positives` other rows of the anchor's label;
    negatives of a positive the first `negatives` rows of other labels with low * positive score <= 100 * negative
    score <= high * positive score. Fewer are returned where there are fewer; an anchor without positives, or a
    positive without negatives, has no rows. Labels are whole numbers. Rows with a null label, a null vector or a null
    or non-finite component take no part; shorter vectors, empty ones too, count as padded by zeros. Repeated rows are
    rows of their own: each counts, and a copy of an anchor is one of the others. A null id is never an anchor unless `anchor` says so.
    Scores must fit in 64 bits: larger vectors raise an error. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, key, vector, label, anchor).withColumn("uid", F.monotonically_increasing_id()))
    n, d, most = rows.agg(F.count("*"), F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda v: F.abs(v))))).first()
    d, most = max(1, d or 0), most or 0
    if d * most * most * 100 >= 1 << 63:
        raise ValueError(f"components up to {most / 256:g} in {d} dimensions: scores don't fit in 64 bits")
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    axes = rotation(rows, d)
    size = max(1, PART_NUMBERS // d)
    parts = max(math.ceil(n / size), min(spark.sparkContext.defaultParallelism, math.ceil(n / 1024)))
    anchors = rows.where("anchor")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("uid").asc()]
    near = _met(rows, anchors, parts, "positive", d, axes, positives)
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("k") <= positives)
    near = written(near.select("anchor", F.col("uid").alias("positive"), F.col("id").alias("p_id"), F.col("score").alias("p_score")))
    listed = near.groupBy(F.col("anchor").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("positive", "p_score"))).alias("p"))
    asked = anchors.join(listed, "uid").select(*anchors.columns, F.col("p.positive").alias("positive"), F.col("p.p_score").alias("p_score"))
    found = _met(rows, asked, parts, "negative", d, axes, negatives, low, high)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))).where(F.col("rank") <= negatives)
    named = found.join(near, ["anchor", "positive"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", F.col("p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    changed = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(changed, F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, CAST(list_dot_product(a.q, e.q) AS BIGINT) AS score FROM e AS a, e WHERE a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS k
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10
"""
