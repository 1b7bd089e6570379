"""Substring dedup over words: super-k-mers travel packed to their minimiser's bucket, where sorting counts windows exactly."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import span_hashes, word_bounds
from rasterloom.llm.windows import Block, covered, repeated

#: Words of a window, and of the runs among which its minimiser is chosen.
SIZE, GRAM = 35, 8


def _counter(size: int):
    def count(strings: list[bytes], windows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Occurrences of each window of the packed strings: windows are sorted by a hash of their bytes, and neighbours of one hash are compared byte by byte."""
        data = np.frombuffer(b"".join(strings), np.uint8)
        offsets = np.cumsum([0, *map(len, strings)])
        starts, ends, rows = word_bounds(data, offsets)
        first = np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
        lo, hi = starts[first], ends[first + size - 1]
        hashes = span_hashes(data, lo, hi)
        order = np.argsort(hashes)
        same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        text = data.tobytes()
        x, y = order[same], order[same + 1]
        for a, b, c, d in zip(lo[x].tolist(), hi[x].tolist(), lo[y].tolist(), hi[y].tolist(), strict=True):
            if text[a:b] != text[c:d]:
                return _by_text(text, lo, hi, np.repeat(values, windows))
        turn = np.ones(len(order), bool)
        turn[same + 1] = False
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(turn) - 1
        return np.bincount(group, np.repeat(values, windows)).astype(np.int64)[group]

    return count


def _by_text(text: bytes, lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The same counts by sorting the windows themselves; used where two windows share a hash."""
    windows = [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    sums: dict[bytes, int] = {}
    for w, v in sorted(zip(windows, values.tolist(), strict=True)):
        sums[w] = sums.get(w, 0) + v
    return np.array([sums[w] for w in windows], np.int64)


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Removes each word covered by a window of `size` words that also starts anywhere else, the same document included.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words joined by one space).
    Windows are judged on the input. Null and empty texts have no words. Rows whose doc_id repeats or is
    null each count as a place of their own, so a repeated row removes its long runs in both. An empty
    table gives no rows; other columns are ignored, whatever their names. A text of any length is read whole, but must fit in a task's memory.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def finish(block: Block | None, firsts: np.ndarray, counts: np.ndarray) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        if block is None:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.string())], names)
        gone = covered(len(block.starts), firsts[counts > 1], size)
        data, kept, removed = block.data, [], []
        for lo, hi in zip(block.rows[:-1].tolist(), block.rows[1:].tolist(), strict=True):
            stay = lo + np.flatnonzero(~gone[lo:hi])
            removed.append(hi - lo - len(stay))
            kept.append(b" ".join([data[s:e].tobytes() for s, e in zip(block.starts[stay].tolist(), block.ends[stay].tolist(), strict=True)]))
        return pa.table([block.table.column("doc_id"), pa.array(np.diff(block.rows)), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], names)

    return repeated(docs, words=True, size=size, gram=gram, by_document=False, compare=_counter(size), finish=finish, result=f"doc_id {key}, n_words long, n_removed long, kept_sha256 string, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) AS u(i)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN dup USING (s), unnest(range(i, i + 35)) AS t(p)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
