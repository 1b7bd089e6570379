"""What several text operators share: scratch tables, blocks of documents, words as arrays."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
#: The mapping for lower-casing A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster that is an error, since executors don't share local folders."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that later stages start from files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Empties a table made by written(), once nothing reads it any more."""
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(df.scratch_path)


def in_blocks(docs: DataFrame, target_bytes: int) -> tuple[DataFrame, int, int]:
    """Documents with a block number, hashed from doc_id and text, so that a block holds about target_bytes of text; the blocks' number; all bytes of text.

    A block is a unit of work for one task; its size doesn't grow with the table, nor with how often one
    doc_id, or none, stands in it.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / target_bytes))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block")), n, total


#: Bytes that a task should read of what is dealt by block or bucket.
TASK_BYTES = 64 << 20


def dealt(df: DataFrame, key: str, size: int) -> DataFrame:
    """df dealt by key, to more partitions than the session's number where a task would read over TASK_BYTES of the size in all."""
    n = math.ceil(size / TASK_BYTES)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one array of UTF-8 bytes and the rows' offsets into it; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    a = a.cast(pa.large_string()).fill_null("") if a.null_count else a.cast(pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last byte of every word, and for each row its first word's number (one entry more than rows). Words don't cross rows."""
    solid = ~_IS_BLANK[data]
    edge = solid.copy()
    edge[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(edge), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept in the process and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(12, n.bit_length())
        out = np.empty(size + 1, np.uint64)
        out[0] = 1
        done = 1
        while done <= size:
            step = min(done, size + 1 - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have = out
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed together: the sums' arrays are eight times as large and should stay in a core's cache.
SPAN_STEP = 1 << 17


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, from prefix sums of a polynomial in the byte values. starts and ends must both ascend."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        first = starts[k]
        # The spans that begin within the step; at least one, however long.
        stop = max(k + 1, int(np.searchsorted(starts, first + SPAN_STEP)))
        part = data[first : ends[stop - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(part))[: len(part)], out=sums[1:])
        lo, hi = starts[k:stop] - first, ends[k:stop] - first
        out[k:stop] = (sums[hi] - sums[lo]) * _power(_BASE_INVERSE, len(part))[lo] + (hi - lo).astype(np.uint64)
        k = stop
    return mixed(out)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` consecutive word hashes; runs may cross rows, callers leave those out."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += words[j : j + n]
    return mixed(out)


def word_text(name: str = "text"):
    """The words of a column as an array, with JVM functions only."""
    return F.regexp_extract_all(F.coalesce(F.col(name), F.lit("")), F.lit(WORD), F.lit(0))


def shares(bucket: np.ndarray):
    """Each bucket that occurs, and the places that have it, in order."""
    order = np.argsort(bucket, kind="stable")
    own, cuts = np.unique(bucket[order], return_index=True)
    ends = np.append(cuts, len(order))
    for b, lo, hi in zip(own.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield b, order[lo:hi]


def slices(batches, column: int | str, target_bytes: int = 4 << 20):
    """Record batches cut so that a binary or text column holds about target_bytes in each, one row at least: bounds what a task holds."""
    for batch in batches:
        size = max(1, batch.column(column).nbytes)
        rows = max(1, int(batch.num_rows * target_bytes / size))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
