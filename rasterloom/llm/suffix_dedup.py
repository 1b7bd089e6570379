"""Suffix-array dedup over bytes: suffixes that share a bucket are ordered by bucket-pointer refinement.

The buckets' strings come from windows.py. Within one, suffixes start in buckets of their first bytes; each
round sorts the suffixes of unsettled buckets by the bucket of the suffix further on, and its new buckets
are what the next round's pointers read, until a window's whole length is compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.windows import Block, covered, repeated

#: Bytes of a window, and of the runs among which its minimiser is chosen.
SIZE, GRAM = 50, 16
#: Leading bytes that make the first buckets.
LEAD = 8


def refined(data: np.ndarray, limits: np.ndarray, size: int) -> np.ndarray:
    """A bucket number for every position of data from which `size` bytes stay within its string, equal just where those bytes are equal; -1 elsewhere.

    limits: for each position, the end of its string.
    """
    n = len(data)
    lead = min(LEAD, size)
    room = limits - np.arange(n)
    bucket = np.full(n, -1, np.int64)
    live = np.flatnonzero(room >= lead)
    if not len(live):
        return bucket
    code = np.zeros(len(live), np.uint64)
    for j in range(lead):
        code = code << np.uint64(8) | data[live + j]
    order = np.argsort(code)
    ranked = code[order]
    turn = np.append(True, ranked[1:] != ranked[:-1])
    # A bucket is named by its first place in the order, so buckets that a round leaves alone keep their names.
    head = np.maximum.accumulate(np.where(turn, np.arange(len(live)), 0))
    bucket[live[order]] = head
    suffixes = live[order]
    known = lead
    while known < size:
        step = min(known, size - known)
        # Suffixes that end too soon have done their part.
        long = room[suffixes] >= known + step
        new = bucket.copy()
        new[suffixes[~long]] = -1
        heads = bucket[suffixes]
        sizes = np.bincount(heads[long], minlength=n)
        open_ = long & (sizes[heads] > 1)
        at = np.flatnonzero(open_)
        if len(at):
            x = suffixes[at]
            pointer = bucket[x + step]
            order = np.argsort(heads[at] * n + pointer)
            x, h, p = x[order], heads[at][order], pointer[order]
            turn = np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]))
            fresh = np.append(True, h[1:] != h[:-1])
            place = np.arange(len(x))
            within = np.maximum.accumulate(np.where(turn, place, 0)) - np.maximum.accumulate(np.where(fresh, place, 0))
            new[x] = h + within
        suffixes, bucket = suffixes[long], new
        known += step
    return bucket


def _smallest(size: int):
    def smallest(strings: list[bytes], windows: np.ndarray, values: np.ndarray) -> np.ndarray:
        data = np.frombuffer(b"".join(strings), np.uint8)
        lengths = np.array([*map(len, strings)])
        ends = np.cumsum(lengths)
        bucket = refined(data, np.repeat(ends, lengths), size)
        first = np.repeat(ends - lengths - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
        out = np.full(len(data), np.iinfo(np.int64).max)
        own = bucket[first]
        np.minimum.at(out, own, np.repeat(values, windows))
        return out[own]

    return smallest


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Removes each byte covered by a `size`-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (binary: the
    remaining bytes, which may cut a character). Strings are judged on the input and don't cross documents.
    Null texts count as empty. Rows of one doc_id are one document for the comparison and each give a row.
    A null doc_id counts as larger than any other. An empty table gives no rows; other columns are ignored,
    whatever their names. A text of any length is read whole, but must fit in a task's memory.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def finish(block: Block | None, firsts: np.ndarray, owners: np.ndarray) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        if block is None:
            return pa.table([*(pa.array([], pa.int64()) for _ in range(4)), pa.array([], pa.string()), pa.array([], pa.binary())], names)
        mine = block.ids[np.searchsorted(block.rows, firsts, "right") - 1]
        gone = covered(len(block.data), firsts[owners < mine], size)
        kept, removed, spans = [], [], []
        for lo, hi in zip(block.rows[:-1].tolist(), block.rows[1:].tolist(), strict=True):
            part = gone[lo:hi]
            removed.append(int(part.sum()))
            spans.append(int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()))
            kept.append(block.data[lo:hi][~part].tobytes())
        return pa.table([block.table.column("doc_id"), pa.array(np.diff(block.rows)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())], names)

    return repeated(docs, words=False, size=size, gram=gram, by_document=True, compare=_smallest(size), finish=finish, result=f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT doc_id, c, substr(x, 400 * c + 1, 498) AS part FROM h, unnest(range(0, CAST(length(x) AS BIGINT) // 400 + 1)) AS u(c)),
win AS (SELECT doc_id, 200 * c + j AS i, substr(part, 2 * j - 1, 100) AS s FROM part, unnest(range(1, least(200, CAST(length(part) AS BIGINT) // 2 - 49) + 1)) AS u(j)),
first AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM win JOIN first USING (s) WHERE d < doc_id),
run AS (SELECT doc_id, i, count(*) FILTER (step IS NULL OR step > 50) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM run GROUP BY doc_id, g),
piece AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM span),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS z, string_agg(substr(x, CAST(2 * y + 1 AS BIGINT), CAST(2 * (a - 1 - y) AS BIGINT)), '' ORDER BY a) AS k FROM piece JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE k || substr(x, CAST(2 * z + 1 AS BIGINT)) END)) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""
