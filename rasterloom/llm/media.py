"""Media columns: PNG files held in a binary column, written and read chunk by chunk, with cosine-transform hashes."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64  #: bytes in a row of samples, and the unit to which payloads are padded
LEVEL = 1  #: of zlib's compression
SIDE = 32  #: the image is averaged down to SIDE x SIDE before its cosine transform
LOW = 8  #: lowest frequencies kept in each direction


class PngError(ValueError):
    """A file that is not a PNG of the supported kind, or whose checksums don't hold."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def png_encode(pixels: np.ndarray) -> bytes:
    """A greyscale PNG of 8-bit samples (rows, columns); each row takes whichever of filters None, Sub, Up has the smallest absolute sum."""
    rows, columns = pixels.shape
    sub = pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    options = np.stack([pixels, sub, up])
    cost = np.minimum(options, np.uint8(0) - options).sum(axis=2, dtype=np.int64)
    pick = cost.argmin(axis=0)
    raw = np.empty((rows, columns + 1), np.uint8)
    raw[:, 0] = pick
    raw[:, 1:] = options[pick, np.arange(rows)]
    head = struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray) -> np.ndarray:
    """Undoes the row filters of one-byte pixels. Runs of rows of one filter are undone together; Average and Paeth go sample by sample."""
    kinds, lines = raw[:, 0], raw[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise PngError("unknown row filter")
    out = np.empty(lines.shape, np.uint8)
    turns = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *turns], [*turns, len(kinds)], strict=True):
        kind, part = kinds[lo], lines[lo:hi]
        above = out[lo - 1] if lo else np.zeros(lines.shape[1], np.uint8)
        if kind == 0:
            out[lo:hi] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind == 2:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[lo:hi])
            out[lo:hi] += above
        else:
            for y in range(lo, hi):
                up = (out[y - 1] if y else np.zeros(lines.shape[1], np.uint8)).tolist()
                left = corner = 0
                row = lines[y].tolist()
                for x, value in enumerate(row):
                    if kind == 3:
                        guess = (left + up[x]) >> 1
                    else:
                        p = left + up[x] - corner
                        a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                        guess = left if a <= b and a <= c else up[x] if b <= c else corner
                    corner, left = up[x], (value + guess) & 255
                    row[x] = left
                out[y] = row
    return out


def png_decode(data: bytes) -> np.ndarray:
    """The samples of a greyscale 8-bit PNG without interlacing. Every chunk's checksum and the order and length of the data are tested."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at, shape, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise PngError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(part) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + part)):
            raise PngError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            columns, rows, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", part)
            if (depth, colour, packing, filtering, interlace) != (8, 0, 0, 0, 0):
                raise PngError("only greyscale 8-bit files without interlacing are read")
            shape = rows, columns
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise PngError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if shape is None or not ended:
        raise PngError("a chunk is missing")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != shape[0] * (shape[1] + 1):
        raise PngError("the data's length doesn't fit the header")
    return _unfilter(raw.reshape(shape[0], shape[1] + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    """The first `low` rows of the orthonormal cosine transform of n samples."""
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    out = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * math.sqrt(2 / n)
    out[0] /= math.sqrt(2)
    return out


_TRANSFORM = _cosines(SIDE, LOW)


def _averaged(pixels: np.ndarray, axis: int) -> np.ndarray:
    """Means of SIDE bands of an axis; an axis shorter than SIDE is repeated up to it first."""
    n = pixels.shape[axis]
    if n < SIDE:
        return np.take(pixels, np.arange(SIDE) * n // SIDE, axis=axis).astype(np.float64)
    cuts = np.arange(SIDE + 1) * n // SIDE
    sums = np.add.reduceat(pixels, cuts[:-1], axis=axis, dtype=np.float64)
    sizes = np.diff(cuts)
    return sums / (sizes[:, None] if axis == 0 else sizes[None])


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: which of the LOW x LOW lowest frequencies lie above their median, the mean's own term left out of it."""
    small = _averaged(_averaged(pixels, 0), 1)
    low = np.round(_TRANSFORM @ small @ _TRANSFORM.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def pngs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text's padded bytes as a PNG in a binary column: key, n_bytes, media.

    A null text counts as empty and gives one row of zeros; rows whose key repeats or is null each
    give their own file. A text of any length is stored whole, but must fit in a task's memory. An empty table gives no rows; other columns are ignored, whatever their names.
    """

    def store(batches):
        for batch in slices(batches, "text"):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            media = [png_encode(np.frombuffer(padded(d), np.uint8).reshape(-1, WIDTH)) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(store, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("key", key)


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads each PNG of a column `media` back: payload's length, digest and last block's checksum, and the hash of its low frequencies.

    A null file has null features. A file that fails a checksum raises PngError: the column is meant to hold what pngs() stored. A file of any length is read whole.
    """

    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches):
        for batch in slices(batches, "media"):
            rows = []
            for m in batch.column("media").to_pylist():
                if m is None:
                    rows.append((None,) * len(kinds))
                    continue
                pixels = png_decode(m)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(pixels)))
            found = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), *found], names)

    schema = f"key {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(read, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(pngs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def payload_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of query() that SQL can state: what was stored comes back whole."""
    return query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM h),
p AS (SELECT doc_id, x, n, greatest(64, (n + 63) // 64 * 64) AS p FROM n)
SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(unhex(x || repeat('00', p - n))) AS payload_sha256 FROM p
"""
