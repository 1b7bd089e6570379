"""Line dedup with a template tree of fixed depth.

A line's tokens with digits are variable fields from the start. The tree's first level is the number of
tokens, the next ones are the leading tokens; a leaf holds the templates that came down there. In a leaf,
templates that agree in most places are linked, and all that are linked over any number of others are one
template, with variable fields where they differ; that doesn't hang on how many a leaf holds. Lines whose
template recurs across documents are dropped, but for the first document that has it.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import dropped, slices, written
from rasterloom.llm.minhash import components

DEPTH = 3  #: leading tokens on the way to a leaf
ALIKE, ALIKE_OF = 4, 5  #: two templates of one leaf are linked if they agree in 4 of 5 places or more
#: Templates that are compared as one leaf; those of a fuller one meet by groups of places, with the same links.
LEAF = 1000
#: Documents in which a template recurs: of at least LONG tokens, and of fewer. Lines under SHORTEST tokens are never dropped.
LONG, LONG_DOCS, SHORT_DOCS, SHORTEST = 8, 3, 10, 3
EXACT_DOCS = 2  #: documents in which one and the same line of at least LONG tokens recurs
FIELD = "<*>"  #: stands for a variable field


def _tokens(line):
    masked = F.when(line.rlike(r"\d"), F.regexp_replace(line, r"[^\x20\x09-\x0D\d]*+\d[^\x20\x09-\x0D]*+", FIELD)).otherwise(line)
    return _words(masked)


def _words(text):
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda t: t != "")


def _digest(tokens):
    return F.unhex(F.md5(F.array_join(tokens, " ")))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, n, leaf, key, exact, raw of every line of at least SHORTEST tokens.

    key is the template's digest; it and leaf are null if most tokens are fields: rows of numbers are no
    template. exact: the template has no field, so key is the line's own digest; raw is that digest otherwise.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.select("doc_id", "line", "content", _tokens(F.col("content")).alias("tokens")).where(F.size("tokens") >= SHORTEST)
    fields, n = F.size(F.filter("tokens", lambda t: t == FIELD)), F.size("tokens")
    leaf = F.when(2 * fields <= n, F.xxhash64(n, F.slice("tokens", 1, DEPTH)))
    return lines.select("doc_id", "line", n.alias("n"), leaf.alias("leaf"), F.when(2 * fields <= n, _digest(F.col("tokens"))).alias("key"), (fields == 0).alias("exact"), F.when(fields > 0, _digest(_words(F.col("content")))).alias("raw"))


def _linked(codes: np.ndarray) -> np.ndarray:
    """For each template (a row of token numbers, -1 for a field) the first one that it is linked with over any number of others."""
    out, left = np.arange(len(codes)), np.arange(len(codes))
    while len(left):
        first, left = left[0], left[1:]
        reached = [first]
        # What is reached once is compared with what is not reached yet only, so a leaf of one kind of line takes few steps.
        while reached and len(left):
            code = codes[reached.pop()]
            near = ALIKE_OF * ((codes[left] == code) & (code >= 0)).sum(axis=1) >= ALIKE * len(code)
            out[left[near]] = first
            reached += left[near].tolist()
            left = left[~near]
    return out


def _merge(batches):
    """key and group of templates that arrive leaf by leaf, for those that are not alone; parted passes through."""

    def rows():
        for batch in slices(batches, "tokens"):
            yield from zip(*(batch.column(c).to_pylist() for c in ("leaf", "key", "parted", "tokens")), strict=True)

    def table():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["key", "group", "parted"])

    out: list[tuple] = []
    for _, leaf in groupby(rows(), key=lambda r: r[0]):
        keys, codes, parted = [], [], False
        numbers: dict[str, int] = {FIELD: -1}
        for _, key, parted, tokens in leaf:
            keys.append(key)
            codes.append(np.array([numbers.setdefault(t, len(numbers)) for t in tokens], np.int32))
        group = _linked(np.stack(codes))
        shared = np.bincount(group, minlength=len(group))[group] > 1
        out += [(keys[k], keys[group[k]], parted) for k in np.flatnonzero(shared).tolist()]
        if len(out) >= 10_000:
            yield table()
            out = []
    if out:
        yield table()


def _merged(words: DataFrame) -> DataFrame:
    """key and group (of a written table) of templates that are linked with others. words: leaf, key, templates (of the leaf), tokens.

    Two templates of n tokens that are linked differ in n // 5 places at most, so of one group of places more
    than that, they agree wholly in one. A full leaf's templates meet by those groups, and their links are joined.
    """
    n, part = F.size("tokens"), F.col("part")
    parts = F.when(F.col("templates") > LEAF, F.floor(n * (ALIKE_OF - ALIKE) / ALIKE_OF).cast("int") + 1).otherwise(1)
    words = words.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = lambda k: F.floor(k * (n - DEPTH) / F.col("parts")).cast("int")
    own = F.xxhash64("leaf", "part", F.slice("tokens", DEPTH + 1 + cut(part), cut(part + 1) - cut(part)))
    words = words.select(F.when(F.col("parts") > 1, own).otherwise(F.col("leaf")).alias("leaf"), "key", (F.col("parts") > 1).alias("parted"), "tokens")
    links = written(words.repartition("leaf").sortWithinPartitions("leaf", "key").mapInArrow(_merge, "key binary, group binary, parted boolean"))
    parted = links.where("parted")
    if parted.isEmpty():
        return links
    joined = components(parted.select(F.col("key").alias("a"), F.col("group").alias("b")))
    out = written(links.where("not parted").select("key", "group").union(joined.toDF("key", "group")))
    dropped(links)
    return out


def recurring(docs: DataFrame) -> DataFrame:
    """doc_id and lines (array of int, from 0): what dedup() drops from each document."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    seen = written(_lines(docs))
    templates = seen.where("key is not null").groupBy("leaf", "key").agg(F.count("*").alias("lines"), F.min(F.struct("doc_id", "line")).alias("one"))
    leaves = templates.groupBy("leaf").agg(F.count("*").alias("templates"), F.sum("lines").alias("lines")).where(f"templates > 1 and lines >= {LONG_DOCS}")
    # Only leaves of several templates need their words: one line stands for each template.
    open_ = templates.join(leaves.select("leaf", "templates"), "leaf").select(F.col("one.doc_id").alias("doc_id"), F.struct(F.col("one.line").alias("line"), "key", "leaf", "lines", "templates").alias("template"))
    open_ = written(open_.groupBy("doc_id").agg(F.collect_list("template").alias("open")))
    # Merged by doc_id at every size: the documents move once, with their lines' numbers, and not line by line.
    wanted = docs.join(open_.hint("merge"), "doc_id").select(F.split("text", "\n").alias("content"), F.explode("open").alias("t"))
    words = wanted.select("t.*", _tokens(F.get("content", F.col("t.line"))).alias("tokens")).dropDuplicates(["key"])
    groups = _merged(words.select("leaf", "key", "templates", "tokens"))
    # A line stands under its own digest, and under its template's, if that is another: one named after the linked templates, or one with fields.
    linked = F.unhex(F.md5(F.concat("group", F.lit(b"*"))))
    ids = F.array_compact(F.array(F.when(F.col("group").isNotNull(), F.struct(linked.alias("id"), F.lit(False).alias("exact"))), F.when(F.col("group").isNull() | F.col("exact"), F.struct(F.col("key").alias("id"), "exact"))))
    placed = seen.where("key is not null").join(groups.select("key", "group"), "key", "left").select("doc_id", "line", "n", F.explode(ids).alias("t")).select("doc_id", "line", "n", F.col("t.id").alias("id"), F.col("t.exact").alias("exact"))
    placed = written(placed.union(seen.where("raw is not null").select("doc_id", "line", "n", F.col("raw").alias("id"), F.lit(True).alias("exact"))))
    spread = placed.groupBy("id", "exact", "doc_id").agg(F.max("n").alias("n")).groupBy("id", "exact").agg(F.count("*").alias("docs"), F.max("n").alias("n"), F.min("doc_id").alias("first"))
    spread = written(spread.where(f"docs >= if(n >= {LONG}, if(exact, {EXACT_DOCS}, {LONG_DOCS}), {SHORT_DOCS})"))
    out = written(placed.join(spread.select("id", "exact", "first"), ["id", "exact"]).where("doc_id <> first").groupBy("doc_id").agg(F.collect_set("line").alias("lines")))
    for table in (seen, open_, groups, placed, spread):
        dropped(table)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of docs, with text less its dropped lines, and n_lines and n_removed.

    A line is dropped if its template recurs in at least LONG_DOCS documents (SHORT_DOCS if it has fewer
    than LONG tokens) and an earlier document, by doc_id, has it too. So is one whose tokens recur as they
    are, digits and all, in EXACT_DOCS documents (or SHORT_DOCS). Lines mostly of variable fields have no
    template, only themselves; those of under SHORTEST tokens are left alone. Null texts stay null with no lines, an
    empty text has one; rows of a null doc_id neither count nor lose lines. Rows of one doc_id are one
    document and lose the same lines. An empty table gives no rows. Columns named n_lines or n_removed are
    replaced; others pass through. A text of any length is read whole, but must fit in a task's memory.
    """
    lost = recurring(docs).select(F.col("doc_id").alias("__lost_id"), F.col("lines").alias("__lost"))
    out = docs.drop("n_lines", "n_removed").join(lost.hint("merge"), F.col("doc_id") == F.col("__lost_id"), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__lost", i)), "\n")
    text = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(kept)
    return out.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.when(F.col("text").isNotNull(), F.size("__lost")), F.lit(0)).cast("long"), "text": text}).drop("__lost_id", "__lost")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
