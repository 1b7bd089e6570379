"""Benchmark decontamination: SimHash fingerprints of item-sized windows in a multi-index, then exact weighted-shingle similarity.

For each item of n words, windows of n words are taken at every place of a text where at least one of the
item's shingles occurs; elsewhere the similarity is 0. A text of fewer words than the item is one window,
compared exactly. A longer text's window's fingerprint of BITS bits comes from prefix sums of its
shingles' bits. The multi-index cuts fingerprints into BLOCKS parts: of two fingerprints at most RADIUS bits
apart, one part differs in at most RADIUS // BLOCKS bits. A table by part and value has each item under
all values one bit from its own; a window looks up all values two bits from its own, so they meet if they are
three bits apart. Candidates within RADIUS are then compared exactly.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import LOWER, mixed, shingle_hashes, slices, span_hashes, text_buffer, word_bounds

SHINGLE = 5  #: words
SIMILARITY = 0.8  #: weighted Jaccard similarity; a shingle weighs as often as it occurs
BITS = 256
#: Sets of similarity 0.8 differ in some 39 of 256 bits, give or take 6; unrelated ones in 128, give or take 8.
RADIUS, BLOCKS = 63, 16
#: Bits that a part may differ in on the item's side and on the window's; together RADIUS // BLOCKS.
ITEM_BITS, WINDOW_BITS = 1, 2
#: Shingles of a text whose sums of bits are held at once.
CHUNK = 1 << 14
#: Items' text that one index holds; a larger benchmark is searched index by index.
INDEX_BYTES = 8 << 20
SIEVE_BITS = 20


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words; of fewer words, one of them all."""
    if len(words) >= SHINGLE:
        return shingle_hashes(words, SHINGLE)
    return mixed(shingle_hashes(words, len(words)) + np.uint64(len(words))) if len(words) else np.zeros(0, np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each hash."""
    words = np.stack([mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _values(bits: int) -> np.ndarray:
    """All values of a part with at most so many bits."""
    every = np.arange(1 << 16, dtype=np.uint32)
    return every[np.bitwise_count(every) <= bits].astype(np.uint16)


@dataclass
class Index:
    ids: list
    counts: list[Counter]
    words: np.ndarray  # of each item
    prints: np.ndarray  # (item, part)
    tables: list[tuple[np.ndarray, np.ndarray]]  # of each part: sorted keys, which are an item's runs and a value, and the items
    shingles: np.ndarray  # sorted, with the items that have them
    cuts: np.ndarray
    items: np.ndarray
    sieve: np.ndarray
    short: np.ndarray  # word counts under SHINGLE that items have

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Index:
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        data = np.frombuffer(LOWER, np.uint8)[data]
        starts, ends, rows = word_bounds(data, offsets)
        hashes = span_hashes(data, starts, ends)
        own = [_shingles(hashes[lo:hi]) for lo, hi in zip(rows[:-1], rows[1:], strict=True)]
        words = np.diff(rows)
        keep = np.flatnonzero(words)
        own, words, ids = [own[k] for k in keep], words[keep], [ids[k] for k in keep]
        prints = np.stack([np.packbits(_bits(x).sum(axis=0) > 0).view(np.uint16) for x in own]) if own else np.zeros((0, BLOCKS), np.uint16)
        kind = words.astype(np.int64)
        tables = []
        for k in range(BLOCKS):
            keys = (kind[:, None] << 16 | (prints[:, k, None] ^ _values(ITEM_BITS)).astype(np.int64)).ravel()
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], np.repeat(np.arange(len(own)), len(keys) // max(1, len(own)))[order]))
        flat = np.concatenate([np.zeros(0, np.uint64), *(np.unique(x) for x in own)])
        item = np.repeat(np.arange(len(own)), [len(np.unique(x)) for x in own]) if own else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        shingles, first = np.unique(flat[order], return_index=True)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(shingles & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)] = True
        return cls(ids, [Counter(x.tolist()) for x in own], words, prints, tables, shingles, np.append(first, len(flat)), item[order], sieve, np.unique(words[words < SHINGLE]))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose shingle some item has, and that shingle's number."""
        at = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)])
        if not len(self.shingles):
            return at[:0], at[:0]
        number = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
        ok = self.shingles[number] == hashes[at]
        return at[ok], number[ok]

    def candidates(self, parts: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of one kind with fingerprints at most RADIUS bits apart. parts: (window, part)."""
        near, pairs = _values(WINDOW_BITS), [np.zeros(0, np.int64)]
        for (keys, items), own in zip(self.tables, parts.T, strict=True):
            value, of = np.unique(own, return_inverse=True)
            probe = kind << 16 | (value[:, None] ^ near).astype(np.int64)
            lo = np.searchsorted(keys, probe)
            n = np.searchsorted(keys, probe, "right") - lo
            which = np.repeat(np.arange(len(value)), n.sum(axis=1))
            lo, n = lo.ravel(), n.ravel()
            found = items[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            # Each value's items go to all windows that have it.
            met = np.unique(which * max(1, len(self.ids)) + found)
            which, found = met // max(1, len(self.ids)), met % max(1, len(self.ids))
            begin = np.searchsorted(which, np.arange(len(value) + 1))
            each = np.diff(begin)[of]
            window = np.repeat(np.arange(len(own)), each)
            pairs.append(window * max(1, len(self.ids)) + found[np.repeat(begin[:-1][of] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // max(1, len(self.ids)), pair % max(1, len(self.ids))
        close = np.bitwise_count(parts[window] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return window[close], item[close]

    def search(self, hashes: np.ndarray, at: np.ndarray, number: np.ndarray, size: int):
        """Matches in one text: item, first shingle's place, similarity. hashes: of the text's runs of `size` words; at, number: its hits."""
        n = self.cuts[number + 1] - self.cuts[number]
        place = np.repeat(at, n)
        item = self.items[np.repeat(self.cuts[number] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        runs = np.maximum(1, self.words - SHINGLE + 1)
        own = self.words[item] >= SHINGLE if size == SHINGLE else self.words[item] == size
        if size == SHINGLE:
            # Of an item that is longer than the text, the whole text is the one window; both real sizes count.
            longer = np.unique(item[own & (runs[item] > len(hashes)) & (len(hashes) >= SIMILARITY * runs[item])]).tolist()
            text = Counter(hashes.tolist()) if longer else Counter()
            for j in longer:
                both = sum((self.counts[j] & text).values())
                union = len(hashes) + int(runs[j]) - both
                if both >= SIMILARITY * union:
                    yield j, 0, both / union
        fits = own & (runs[item] <= len(hashes))
        place, item = place[fits], item[fits]
        if not len(item):
            return
        wanted = []
        for length in np.unique(runs[item]).tolist():
            mine = runs[item] == length
            # Every window of that length over a hit, once.
            step = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(step, np.maximum(0, place[mine] - length + 1), 1)
            np.add.at(step, np.minimum(place[mine], len(hashes) - length) + 1, -1)
            wanted.append((length, np.flatnonzero(np.cumsum(step[:-1]) > 0)))
        for lo in range(0, len(hashes), CHUNK):
            here = [(length, first[np.searchsorted(first, lo) : np.searchsorted(first, lo + CHUNK)]) for length, first in wanted]
            here = [(length, first) for length, first in here if len(first)]
            if not here:
                continue
            part = hashes[lo : max(int(first[-1]) + length for length, first in here)]
            sums = np.zeros((len(part) + 1, BITS), np.int32)
            np.cumsum(_bits(part), axis=0, out=sums[1:])
            for length, first in here:
                parts = np.packbits(sums[first - lo + length] - sums[first - lo] > 0, axis=1).view(np.uint16)
                kind = length + SHINGLE - 1 if size == SHINGLE else size
                for k, j in zip(*(x.tolist() for x in self.candidates(parts, kind)), strict=True):
                    k = int(first[k])
                    both = sum((self.counts[j] & Counter(hashes[k : k + length].tolist())).values())
                    if both >= SIMILARITY * (2 * length - both):
                        yield j, k, both / (2 * length - both)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, item_id, n_windows, first_word and similarity (the largest) for each text and item with a window of 0.8 or more.

    Texts and items are lower-cased in A-Z; words are runs without blanks. Null, empty and blank texts and
    items match nothing; an item of fewer than five words matches those words in a row. Rows whose key
    repeats or is null are searched one by one, a text shorter than an item is held whole against it, items that repeat are found under each item_id. Empty
    tables give no rows; other columns are ignored, whatever their names. A text of any length is read whole, but must fit in a task's memory.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, item_id long, n_windows long, first_word long, similarity double"
    source = docs.select(F.col(key).alias("key"), "text").where(F.col("text").isNotNull())

    def found(shared):
        def run(batches):
            index: Index = shared.value
            for batch in slices(batches, "text", 1 << 20):
                data, offsets = text_buffer(batch.column("text"))
                data = np.frombuffer(LOWER, np.uint8)[data]
                starts, ends, rows = word_bounds(data, offsets)
                words = span_hashes(data, starts, ends)
                best: dict[tuple[int, int], list] = {}
                for size in [SHINGLE, *index.short.tolist()]:
                    hashes = shingle_hashes(words, size)
                    if size < SHINGLE:
                        hashes = mixed(hashes + np.uint64(size))
                    at, number = index.hits(hashes)
                    row = np.searchsorted(rows, at, "right") - 1
                    inside = at + size <= rows[row + 1]
                    at, number, row = at[inside], number[inside], row[inside]
                    for r in np.unique(row).tolist():
                        mine = row == r
                        lo, hi = rows[r], rows[r + 1] - size + 1
                        for j, k, similarity in index.search(hashes[lo:hi], at[mine] - lo, number[mine], size):
                            have = best.setdefault((r, j), [0, k, 0.0])
                            have[0] += 1
                            if similarity > have[2]:
                                have[1:] = [k, similarity]
                out = [(r, index.ids[j], *v) for (r, j), v in sorted(best.items())]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True))], ["key", "item_id", "n_windows", "first_word", "similarity"])

        return source.mapInArrow(run, schema)

    out = None
    ids, texts, held = [], [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length(F.trim("text")) > 0).toLocalIterator()
    for r in items:
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text.encode())
        if held >= INDEX_BYTES:
            part = found(spark.sparkContext.broadcast(Index.of(ids, texts)))
            out = part if out is None else out.union(part)
            ids, texts, held = [], [], 0
    if ids or out is None:
        part = found(spark.sparkContext.broadcast(Index.of(ids, texts)))
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
