"""Finding windows that repeat across documents, without moving the documents' unique text.

A window is `size` consecutive units (words or bytes) of one document. Its minimiser is the smallest hash
among its `gram`-unit runs; consecutive windows that share a minimiser at one place form a super-window.
Equal windows have equal minimisers, so

1. each block of documents sends its distinct minimisers, dealt by hash, and learns which occur more than once;
2. only super-windows with such a minimiser travel, each distinct one once a block, as one packed string to its
   minimiser's bucket, where their windows are compared exactly;
3. the answers return to the blocks, which mark the units.

A minimiser of very many different super-windows would make one bucket large: its windows travel one by one
instead, as strings dealt by their own hash, so they spread out, and equal ones are one string a block.
What a task holds is a block or a bucket; their number, not their size, grows with the input. A block sends
one row to each bucket that it has something for, so rows are never more than minimisers; as they are blocks
times buckets, both are large, and a bucket is compared part by part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rasterloom.llm.common import dealt, in_blocks, mixed, shares, shingle_hashes, span_hashes, text_buffer, word_bounds

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes of minimisers, and of packed strings, that a bucket should hold.
BUCKET_BYTES = 8 << 20
#: Parts of a bucket that are compared apart, each small enough for a core's cache.
PARTS = 32
#: Strings, different ones of each block, from which a minimiser's windows travel one by one; they are compared all the same.
HOT = 10_000
#: Units looked at together; the low bits of a minimiser's key hold its place.
PLACE_BITS = 22
#: The low bits of a minimiser are nought; where a block counts its strings, they hold what tells these apart.
MARK_BITS = 14
STEP = 1 << 18
NO_DOCUMENT = np.iinfo(np.int64).max  #: stands for a null doc_id; it's smaller than none


@dataclass
class Block:
    """A block's texts in one array; units are words or bytes."""

    ids: np.ndarray  # of each row; NO_DOCUMENT for null
    table: pa.Table
    data: np.ndarray
    rows: np.ndarray  # first unit of each row, and the end
    starts: np.ndarray | None  # of words, in bytes
    ends: np.ndarray | None

    @classmethod
    def of(cls, table: pa.Table, words: bool) -> Block:
        # Rows arrive in any order after a shuffle; a fixed one makes places the same in every pass.
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = pc.fill_null(table.column("doc_id").cast(pa.int64()), int(NO_DOCUMENT)).to_numpy()
        data, offsets = text_buffer(table.column("text"))
        if not words:
            return cls(ids, table, data, offsets, None, None)
        starts, ends, rows = word_bounds(data, offsets)
        return cls(ids, table, data, rows, starts, ends)

    def packed(self, first: int, last: int) -> bytes:
        """The units first..last - 1 as one string; words are joined by one space."""
        if self.starts is None:
            return self.data[first:last].tobytes()
        if self.ends[last - 1] - self.starts[first] == (self.ends[first:last] - self.starts[first:last] + 1).sum() - 1 and (last == first + 1 or (self.data[self.ends[first : last - 1]] == 32).all()):
            return self.data[self.starts[first] : self.ends[last - 1]].tobytes()
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last], strict=True))


def _gram_hashes(block: Block, gram: int) -> Callable[[int, int], np.ndarray]:
    """A hash for every run of `gram` units, from the lo-th to before the hi-th."""
    if block.starts is not None:
        hashes = shingle_hashes(span_hashes(block.data, block.starts, block.ends), gram)
        return lambda lo, hi: hashes[lo:hi]

    def of_bytes(lo: int, hi: int) -> np.ndarray:
        data = block.data[lo : hi + gram - 1]
        eights = np.lib.stride_tricks.sliding_window_view(data, 8)
        eights = np.ascontiguousarray(eights).view("<u8").ravel()
        n = len(data) - gram + 1
        out = eights[:n] * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += eights[gram - 8 : gram - 8 + n]
        return mixed(out)

    return of_bytes


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1]) if width > have else out


def super_windows(block: Block, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each super-window: row, first window, number of windows, minimiser, and a hash of its first and last run, which tells most strings of a minimiser apart."""
    grams = _gram_hashes(block, gram)
    width = size - gram + 1
    total = max(0, block.rows[-1] - size + 1) if len(block.rows) else 0
    none = np.zeros(0, np.int64)
    starts, ends = block.rows[:-1], block.rows[1:]
    out = []
    for lo in range(0, total, STEP):
        hi = min(total, lo + STEP)
        part = grams(lo, hi + width - 1)
        keys = part >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
        keys |= np.arange(len(part), dtype=np.uint64)
        place = _sliding_min(keys, width) & np.uint64((1 << PLACE_BITS) - 1)
        # The last size - 1 starts of a row make no window, so windows of two rows are never neighbours.
        near = slice(np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi + size))
        step = np.zeros(hi - lo + 1, np.int32)
        np.add.at(step, np.clip(np.maximum(starts[near], ends[near] - size + 1), lo, hi) - lo, 1)
        np.add.at(step, np.clip(ends[near], lo, hi) - lo, -1)
        ok = np.cumsum(step[:-1]) == 0
        same = (place[1:] == place[:-1]) & ok[1:] & ok[:-1]
        turn, last = ok.copy(), ok
        turn[1:] &= ~same
        last[:-1] &= ~same
        at = np.flatnonzero(turn)
        windows = np.flatnonzero(last) - at + 1
        chosen = part[place[at].astype(np.int64)] >> np.uint64(MARK_BITS) << np.uint64(MARK_BITS)
        marks = mixed(part[at] + windows.astype(np.uint64)) ^ part[at + windows + width - 2]
        out.append((np.searchsorted(block.rows, at + lo, "right") - 1, at + lo, windows, chosen, marks))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def counted(minimisers: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct minimisers, and for each in 15 bits how many of its super-windows differ, with a bit above if it occurs more than once."""
    both = np.sort(minimisers | marks >> np.uint64(64 - MARK_BITS))
    hashes = both >> np.uint64(MARK_BITS) << np.uint64(MARK_BITS)
    head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(both) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(both)))
    differ = np.cumsum(np.append(True, both[1:] != both[:-1]))
    strings = np.diff(np.append(differ[head], differ[-1] + 1)) if len(both) else times
    return hashes[head], (strings | (times > 1) << 15).astype(np.uint16)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


_MINIMISERS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_KINDS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("kinds", pa.binary())])
_PACKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hot", pa.bool_()), ("lengths", pa.binary()), ("parts", pa.binary()), ("strings", pa.binary()), ("owners", pa.binary()), ("firsts", pa.binary()), ("counts", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int64()), ("firsts", pa.binary()), ("windows", pa.binary()), ("answers", pa.binary())])
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(buckets)).astype(np.int64)


def _string_hashes(strings: list[bytes]) -> np.ndarray:
    ends = np.cumsum([*map(len, strings)])
    return span_hashes(np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


#: Compares windows: gets the distinct packed strings of one bucket, their numbers of windows, and a value each; gives each window's answer, string by string.
Compare = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]


def repeated(docs: DataFrame, *, words: bool, size: int, gram: int, by_document: bool, compare: Compare, finish: Callable[[Block, np.ndarray, np.ndarray], pa.Table], result: str) -> DataFrame:
    """Runs the three steps. Values are counts of occurrences, or with by_document the smallest doc_id that has them.

    finish gets a block and, for windows that were compared, their first units and their answers: the
    number of occurrences everywhere, or the smallest doc_id. It returns the block's result rows.
    """
    blocked, n_blocks, total = in_blocks(docs, BLOCK_BYTES)
    units = total / (6 if words else 1)
    buckets = max(1, math.ceil(units * 16 / (size - gram + 2) / BUCKET_BYTES))
    packed_buckets = max(1, math.ceil(total / BUCKET_BYTES))

    def send(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        hashes, counts = counted(*super_windows(Block.of(table, words), size, gram)[3:])
        return _table(_MINIMISERS, [(b, number, _short(hashes[at]), counts[at].tobytes()) for b, at in shares(_dealt(hashes, buckets))])

    def tell(table: pa.Table) -> pa.Table:
        hashes = [_long(x.as_py()) for x in table.column("hashes")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("counts")])
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        often = np.bincount(inverse, 1 + (counts >> 15)) > 1
        kinds = (often.astype(np.uint8) + (often & (np.bincount(inverse, counts & 0x7FFF) >= HOT)))[inverse]
        cuts = np.cumsum([0, *map(len, hashes)])
        bucket = table.column("bucket")[0].as_py()
        return _table(_KINDS, [(b.as_py(), bucket, kinds[lo:hi].tobytes()) for b, lo, hi in zip(table.column("block"), cuts[:-1], cuts[1:], strict=True)])

    def pack(table: pa.Table, kinds: pa.Table) -> pa.Table:
        if not table.num_rows or not kinds.num_rows:
            return _PACKED.empty_table()
        number = table.column("block")[0].as_py()
        block = Block.of(table, words)
        row, first, windows, minimiser, _ = super_windows(block, size, gram)
        distinct = np.unique(minimiser)
        kind = np.zeros(len(distinct), np.uint8)
        mine = dict(shares(_dealt(distinct, buckets)))
        for b, k in zip(kinds.column("bucket").to_pylist(), kinds.column("kinds").to_pylist(), strict=True):
            kind[mine[b]] = np.frombuffer(k, np.uint8)
        kind = kind[np.searchsorted(distinct, minimiser)]
        rows = []
        for hot in (False, True):
            at = np.flatnonzero(kind == 1 + hot)
            r, f, m, w = row[at], first[at], minimiser[at], windows[at]
            if hot:
                r, m, f = np.repeat(r, w), np.repeat(m, w), np.repeat(f - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())
                w = np.ones(len(f), np.int64)
            found: dict[bytes, int] = {}
            owner, heads = np.zeros(len(f), np.int64), []
            for k, (x, y) in enumerate(zip(f.tolist(), w.tolist(), strict=True)):
                string = block.packed(x, x + y + size - 1)
                j = found.setdefault(string, len(heads))
                if j == len(heads):
                    heads.append(k)
                owner[k] = j
            if not heads:
                continue
            strings = list(found)
            keys = _string_hashes(strings) if hot else m[heads]
            value = np.bincount(owner, minlength=len(heads))
            if by_document:
                value = np.full(len(heads), NO_DOCUMENT)
                np.minimum.at(value, owner, block.ids[r])
            parts = _dealt(keys, packed_buckets * PARTS)
            goes = parts // PARTS
            place = np.empty(len(goes), np.int64)
            for (b, mine), (_, uses) in zip(shares(goes), shares(goes[owner]), strict=True):
                place[mine] = np.arange(len(mine))
                text = [strings[j] for j in mine.tolist()]
                rows.append((b, number, hot, _squeezed(np.array([len(t) for t in text], np.int32)), _squeezed((parts[mine] % PARTS).astype(np.uint8)), _squeezed(b"".join(text)), _squeezed(place[owner[uses]].astype(np.int32)), _squeezed(np.diff(f[uses], prepend=0).astype(np.int32)), _squeezed(value[mine])))
        return _table(_PACKED, rows)

    def meet(table: pa.Table) -> pa.Table:
        out = []
        for hot in (False, True):
            part = table.filter(pc.equal(table.column("hot"), hot))
            if not part.num_rows:
                continue
            column = lambda name, kind: [np.frombuffer(_restored(x), kind) for x in part.column(name).to_pylist()]  # noqa: E731, B023
            lengths, values = column("lengths", np.int32), np.concatenate(column("counts", np.int64))
            sizes = [len(x) for x in lengths]
            found: dict[bytes, int] = {}
            same = np.empty(sum(sizes), np.int64)
            k = 0
            for blob, cut in zip(part.column("strings").to_pylist(), lengths, strict=True):
                blob, at = _restored(blob), 0
                for n in cut.tolist():
                    same[k] = found.setdefault(blob[at : at + n], len(found))
                    at, k = at + n, k + 1
            # Windows of one string are answered together, and strings part by part.
            of = np.empty(len(found), np.uint8)
            of[same] = np.concatenate(column("parts", np.uint8))
            order = np.argsort(of, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            same, strings = rank[same], list(found)
            strings = [strings[k] for k in order.tolist()]
            value = np.zeros(len(strings), np.int64)
            if by_document:
                value[:] = NO_DOCUMENT
                np.minimum.at(value, same, values)
            else:
                np.add.at(value, same, values)
            if hot:
                windows, answers = np.ones(len(strings), np.int64), value
            else:
                windows = np.array([(s.count(b" ") + 1 if words else len(s)) - size + 1 for s in strings])
                ends = np.flatnonzero(np.diff(of[order].astype(np.int64), append=-1)) + 1
                answers = np.concatenate([compare(strings[lo:hi], windows[lo:hi], value[lo:hi]) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)])
            begins = np.concatenate([[0], np.cumsum(windows)])
            cuts = np.cumsum([0, *sizes])
            for b, lo, hi, owner, first in zip(part.column("block").to_pylist(), cuts[:-1], cuts[1:], column("owners", np.int32), column("firsts", np.int32), strict=True):
                own = same[lo:hi][owner]
                w = windows[own]
                ends = np.cumsum(w)
                all_answers = answers[np.repeat(begins[own] - np.concatenate([[0], ends[:-1]]), w) + np.arange(ends[-1])]
                out.append((b, _squeezed(first), _squeezed(w.astype(np.int32)), _squeezed(_runs(all_answers))))
        return _table(_ANSWERS, out)

    def settle(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish(None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        firsts, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for f, w, a in zip(*(answers.column(c).to_pylist() for c in ("firsts", "windows", "answers")), strict=True):
            f, w = np.cumsum(np.frombuffer(_restored(f), np.int32), dtype=np.int64), np.frombuffer(_restored(w), np.int32).astype(np.int64)
            ends = np.cumsum(w)
            firsts.append(np.repeat(f - np.concatenate([[0], ends[:-1]]), w) + np.arange(ends[-1]))
            values.append(_unrun(_restored(a)))
        return finish(Block.of(table, words), np.concatenate(firsts), np.concatenate(values))

    blocked = dealt(blocked, "block", total)
    minimisers = blocked.groupBy("block").applyInArrow(send, _sql(_MINIMISERS))
    kinds = dealt(minimisers, "bucket", buckets * BUCKET_BYTES).groupBy("bucket").applyInArrow(tell, _sql(_KINDS))
    strings = blocked.groupBy("block").cogroup(kinds.groupBy("block")).applyInArrow(pack, _sql(_PACKED))
    answers = dealt(strings, "bucket", total).groupBy("bucket").applyInArrow(meet, _sql(_ANSWERS))
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settle, result)


def _squeezed(data: bytes | np.ndarray) -> bytes:
    """data, compressed, after its length in 8 bytes."""
    data = data.tobytes() if isinstance(data, np.ndarray) else data
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _short(hashes: np.ndarray) -> bytes:
    """40 bits of each hash, others than those that deal it. In a bucket, whose size is fixed, they hardly ever agree by chance, and if so some windows more are compared."""
    return mixed(hashes).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _runs(x: np.ndarray) -> bytes:
    """Run lengths and values; neighbouring windows mostly have one answer."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return np.concatenate([[len(at)], np.diff(np.append(at, len(x))), x[at]]).astype(np.int64).tobytes()


def _unrun(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.int64)
    n = int(x[0])
    return np.repeat(x[1 + n :], x[1 : 1 + n])


def covered(n: int, firsts: np.ndarray, size: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of firsts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, firsts, 1)
    np.add.at(step, firsts + size, -1)
    return np.cumsum(step[:n]) > 0
