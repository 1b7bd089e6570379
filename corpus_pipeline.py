"""A corpus pipeline: toxicity, line dedup, near dedup, decontamination, then encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), where docs has the columns of
documents, and returns what it keeps. run() writes each stage's result in the shared folder and reads it
as the next one's docs, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from rasterloom.llm.common import written


#: Similarity from which documents are near duplicates, in percent; op2_minhash's own contract says 85.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores under 0.5, with all their columns.

    The network learns from this stage's labelled documents; without labels all stay. Null and empty texts
    score as the labels' share of toxic ones says, rows of a null or repeated doc_id one by one, texts of any
    length by all their windows. An empty table stays empty.
    """
    return toxicity.harmless(docs, toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines, with all their columns; n_chars, if there is one, is counted anew.

    Documents that consisted of such lines only go; those that were empty or null stay, and so do rows of a
    null doc_id. Rows of one doc_id lose the same lines. Columns named n_lines and n_removed are the
    documents' own and pass through. An empty table stays empty.
    """
    hidden = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup.dedup(docs.withColumnsRenamed(hidden))
    emptied = (F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0)
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({own: c for c, own in hidden.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of NEAR percent or more), that of the smallest doc_id, with all its columns.

    Empty and null documents and those of a null doc_id stay. Rows of one doc_id stay or go together. Texts
    of any length are compared whole. An empty table stays empty.
    """
    others = minhash.near_duplicates(docs, NEAR).where("not kept").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item, with all their columns.

    Null, empty and blank texts match nothing and stay; of rows of one doc_id all go if one matches; rows of a
    null doc_id stay. Texts of any length are searched whole. An empty table stays empty.
    """
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, a row for each row of docs.

    Null texts count as empty; rows of a null or repeated doc_id are encoded one by one; texts of any length
    are encoded whole. An empty table stays empty, and other columns are left out.
    """
    return bpe.digests(docs, bpe.vocabulary_text())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No stage of these can be stated in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
