"""MinHash near-dedup with circulant signatures, exact Jaccard verification and connected components.

Two permutations make every coordinate of a signature: the first scatters a shingle over the hash range,
the second ranks the shingles, and is shifted circularly by one more step for each further coordinate.
Bands of coordinates name buckets. A large bucket's members are not paired with each other: all meet its
hub, the member with the most bucket-mates, and what is linked is joined into components. Two members of
different components can only be linked if they share enough shingles that the hub lacks (or are among the few of certain sizes, which are named). Those are put in
an order, useless ones and rare ones first, and of each member as many from the front as must hold a shared
one name the next groups, of which only those matter that hold two components. No link between different
components is lost, and no pair within a component is named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import LOWER, dropped, mixed, shingle_hashes, slices, span_hashes, text_buffer, word_bounds, written

SHINGLE = 5  #: words
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bands of so many coordinates: two sets of similarity 0.85 share no band with probability (1 - 0.85**4)**24, or 2e-8; of 0.8, 3e-6.
BANDS, BAND_ROWS = 24, 4
#: Fixed odd multipliers of the two permutations, and the step of the circular shift.
FIRST, SECOND, SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0x27D4EB2F)


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and each text's first one. Texts are lower-cased in A-Z; one of fewer than SHINGLE words is one shingle."""
    data, offsets = text_buffer(column)
    data = np.frombuffer(LOWER, np.uint8)[data]
    starts, ends, rows = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    n = np.diff(rows)
    runs = shingle_hashes(words, SHINGLE)
    text = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(rows[1:][text[: len(runs)]] >= np.arange(len(runs)) + SHINGLE)
    own, hashes = text[whole], runs[whole]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        value = np.array([int(shingle_hashes(words[rows[k] : rows[k + 1]], n[k])[0]) for k in short.tolist()], np.uint64)
        own, hashes = np.append(own, short), np.append(hashes, mixed(value + n[short].astype(np.uint64)))
        order = np.argsort(own, kind="stable")
        own, hashes = own[order], hashes[order]
    # Texts are in order already, so each is sorted by itself, which takes far less than a sort of all by two keys.
    cuts = np.searchsorted(own, np.arange(len(n) + 1)).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        hashes[lo:hi].sort()
    if len(own):
        fresh = np.append(True, (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1]))
        own, hashes = own[fresh], hashes[fresh]
    return hashes, np.searchsorted(own, np.arange(len(n) + 1))


def circulant_bands(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Band keys (set, band) of non-empty sets."""
    scattered = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    scattered = scattered ^ scattered >> np.uint32(15)
    scattered *= FIRST
    scattered ^= scattered >> np.uint32(13)
    keys = np.zeros((len(firsts) - 1, BANDS), np.uint64)
    turned = scattered.copy()
    for k in range(BANDS * BAND_ROWS):
        turned += SHIFT
        ranks = turned ^ turned >> np.uint32(16)
        ranks *= SECOND
        ranks ^= ranks >> np.uint32(13)
        keys[:, k // BAND_ROWS] = keys[:, k // BAND_ROWS] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(ranks, firsts[:-1])
    return mixed(keys + np.arange(BANDS, dtype=np.uint64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits that name the set; null of an empty one) and bands (array of long) of each text."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            hashes, firsts = shingle_sets(batch.column("text"))
            sizes = np.diff(firsts)
            full = np.flatnonzero(sizes)
            keys, bands = [None] * len(sizes), [None] * len(sizes)
            if len(full):
                begin = firsts[:-1][full]
                found = circulant_bands(hashes, np.append(begin, len(hashes))).view(np.int64)
                one = np.add.reduceat(mixed(hashes), begin)
                two = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), begin)
                for k, a, b, row in zip(full.tolist(), one, two, found.tolist(), strict=True):
                    keys[k], bands[k] = a.tobytes() + b.tobytes(), row
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


#: Members of a group that is compared pair by pair, at most: in buckets, and in later groups, where only pairs across components are left.
SMALL, SMALL_LATER = 8, 64


def shingle_table(texts: DataFrame) -> DataFrame:
    """id, n, shingles (sorted hashes) of each text. texts: doc_id, text."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            hashes, firsts = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(firsts)), pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(hashes.view(np.int64)))], ["id", "n", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, "id long, n long, shingles array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each pair (a, b) with its other columns, linked, both (size of the intersection), n_a, n_b and, where its column hub is true, rest: b's shingles that a lacks."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("y"))
    met = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")).cast("long"))
    linked = 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
    return met.select(*pairs.columns, linked.alias("linked"), "both", "n_a", "n_b", F.when(F.col("hub"), F.array_except("y", "x")).alias("rest"))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of rows (keys, id, rank, component, open) that hold two components and an open member, named by g; of groups with equal members, one."""
    marks = [F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1)))]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("open").alias("o"), marks[0].alias("m1"), marks[1].alias("m2")).where("o and lo <> hi")
    named = counts.dropDuplicates(["n", "m1", "m2"]).select(*keys, F.xxhash64("n", "m1", "m2").alias("g"), "n")
    return rows.join(named, keys).select("g", "id", "rank", "component", "n")


def _next(met: DataFrame, named: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups (g, id, rank, component, n), and pairs (a, b), of members of different components that a hub has left open and that can still be linked.

    met: what compared() says of hubs a and members b; named: node, component. A set y is linked only with
    sets that share percent of its shingles. What the hub h has of them falls short by need, so x and y
    share that many outside h, and one of them is among y's first len(rest) - need + 1 in any fixed order;
    the order starts with shingles that only one component has. If h has enough of y, x and y may share
    nothing else, but then h has most of x too, and x is of certain sizes; those pairs are named by size.
    """
    t, c = percent / 100, percent / (100 + percent)
    own = lambda side, name: named.select(F.col("node").alias(side), F.col("component").alias(name))
    placed = met.join(own("a", "c_a"), "a", "left").join(own("b", "c_b"), "b", "left")
    placed = placed.select("a", F.col("b").alias("id"), "rank", F.coalesce("c_b", "b").alias("component"), (F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).alias("open"), "both", F.col("n_b").alias("n"), "rest")
    need = F.ceil(t * F.col("n") - 1e-6).cast("long") - F.col("both")
    placed = placed.withColumn("spare", F.greatest(need, F.lit(1)) - 1)
    hubs = placed.groupBy("a").agg(F.max("open").alias("o")).where("o").drop("o")
    placed = written(placed.join(hubs, "a"))
    shared = placed.select("a", "id", "rank", "component", "open", "spare", F.explode("rest").alias("s"))
    useful = shared.groupBy("a", "s").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("open").alias("o")).where("o and lo <> hi")
    own_rows = Window.partitionBy("a", "id")
    ranked = shared.join(useful.select("a", "s", "df"), ["a", "s"])
    ranked = ranked.withColumn("turn", F.row_number().over(own_rows.orderBy("df", "s"))).withColumn("of", F.count("*").over(own_rows))
    groups = written(_groups(ranked.where("not open or turn <= of - spare").select("a", "s", "id", "rank", "component", "open"), ["a", "s"]))
    least, most = F.ceil(t * F.col("n") - 1e-6).cast("long"), F.floor(F.col("both") / c - F.col("n") + 1e-6).cast("long")
    few = placed.where("open").where(most >= least).select("a", F.col("id").alias("x"), F.col("component").alias("c_x"), F.col("n").alias("n_x"), F.explode(F.sequence(least, most)).alias("n"))
    fits = (F.col("c_x") != F.col("component")) & (F.col("both") + 1e-6 >= c * (F.col("n_x") + F.col("n")))
    pairs = few.join(placed.select("a", "id", "component", "n", "both"), ["a", "n"]).where(fits).select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    pairs = written(pairs)
    dropped(placed)
    return groups, pairs


def all_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, component: what links between members of a common bucket connect. members: bucket, id (once a bucket), degree; sets: of shingle_table()."""
    rows = members.select("bucket", "id", F.col("degree").alias("rank"), F.col("id").alias("component"), F.lit(True).alias("open"))
    groups, named, more, most = written(_groups(rows, ["bucket"])), None, None, SMALL
    while True:
        low = groups.where(F.col("n") <= most)
        ends = [low.select("g", F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in ("a", "b")]
        direct = ends[0].join(ends[1], "g").where("a < b and c_a <> c_b").select("a", "b")
        direct = (direct if more is None else direct.union(more)).distinct()
        high = groups.where(F.col("n") > most).drop("n")
        hubs = high.groupBy("g").agg(F.max_by("id", F.struct("rank", -F.col("id"))).alias("a"))
        # Groups of one hub go on as one, so a member stands once beside it, however many bands they share.
        pairs = high.join(hubs, "g").where("id <> a").select("a", F.col("id").alias("b"), "rank").distinct()
        all_pairs = direct.select("a", "b", F.lit(None).cast("long").alias("rank"), F.lit(False).alias("hub")).union(pairs.withColumn("hub", F.lit(True)))
        met = written(compared(all_pairs, sets, percent))
        fresh = met.where("linked").select("a", "b")
        found = components(fresh if named is None else fresh.union(named.toDF("a", "b")))
        for table in (groups, named, more):
            if table is not None:
                dropped(table)
        open_, named, most = met.where("hub"), found, SMALL_LATER
        if open_.isEmpty():
            dropped(met)
            return named
        groups, more = _next(open_, found, percent)
        dropped(met)


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of links (a, b).

    Alternates large-star and small-star steps until nothing changes; each step is one shuffle by node,
    and its result is written out, so a lost executor costs one step.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(own.toDF("a", "b")).distinct()
        after = written(small)
        sums = after.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()
        dropped(edges)
        edges = after
        if sums == before:
            break
        before = sums
    out = written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    dropped(edges)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept: documents linked by 100 * intersection >= percent * union of their shingle sets.

    Documents of equal sets are one class, named by its smallest doc_id; only class representatives are
    compared. Null, empty and blank texts have an empty set and are linked with nothing. A repeated
    (doc_id, text) row is one of a class with itself; rows of a null doc_id are returned alone. An empty
    table gives no rows; other columns are ignored, whatever their names. A text of any length is read whole, but must fit in a task's memory.
    Of different texts of one doc_id the largest stands for it in comparisons.
    """
    signed = written(signatures(docs))
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.any_value("bands").alias("bands"))
    classes = written(classes)
    members = classes.select(F.col("class_id").alias("id"), F.explode("bands").alias("bucket"))
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = written(members.join(shared, "bucket"))
    degrees = written(members.groupBy("id").agg(F.sum("n").alias("degree")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(degrees.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    sets = written(shingle_table(texts))
    found = all_links(members.drop("n").join(degrees, "id"), sets, percent)
    named = classes.select("set_key", "class_id").join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_key", "class_id", F.coalesce("component", "class_id").alias("component"))
    named = written(named)
    for table in (classes, shared, members, degrees, sets, found):
        dropped(table)
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
