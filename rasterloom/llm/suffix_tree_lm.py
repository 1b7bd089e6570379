"""Language-model scoring with a probabilistic suffix tree.

The tree's symbols are the words that training meets at least LEAST times, the end of a text, and one symbol
for all rarer words, which then divide that symbol's probability as their own counts do. A context is up to
DEPTH symbols, none of them rare, after the start of the text or later. It is kept if training meets it at
least LEAST times and its next-symbol distribution diverges from that of the longest kept context within it.
Distributions are smoothed towards that shorter context's. LEAST is the same at every size: the tree grows
with the corpus. It stays a table dealt by hash: it is never gathered.

Word counts are exact over all training texts: blocks send their distinct words dealt by hash, and the
totals return to the blocks that asked, as arrays in the order that they asked in. Blocks are coded once, as
numbers of their own distinct words, and stored in the partitions that each turn reads them by; answers are
stored in the same partitions, so texts, codes and answers are each shuffled once. The tree grows by depth in
the same way as words are counted. In each turn blocks send, packed by bucket, the distinct pairs of context and next symbol of one
more depth, of contexts only that are met often enough, as the turn before told; and of the depth before, each
context's sums of what the test of divergence adds up, which need no pair to travel again. A pair's count,
and whether a context is kept, are all that returns.

Buckets number their frequent words, and their pairs that may be contexts, from the most frequent on. A pair
is the number of its context and that of its next symbol, and pairs are dealt by context, so a block sends
them as lists in small steps, whose size doesn't depend on how many blocks and buckets there are. A context of
very many places is dealt to several buckets by the next symbol.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import LOWER, TASK_BYTES, dealt, in_blocks, mixed, scratch_dir, shares, span_hashes, text_buffer, word_bounds

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
LEAST = 20  #: see least_count()
DEPTH = 3
SMOOTHING = 20.0  #: weight of the shorter context, in tokens
RARE, END, START, FIRST = 0, 1, 2, 3  #: symbols of a block; its frequent words follow
FOLDS = 10  #: texts with crc32(doc_id as text) mod 10 = 0 are held out
PRIOR = 0.1
SPLIT = 1 << 20  #: places of a context that one bucket takes, about
STEP_BITS = 40  #: of a context's number within its bucket
UNITS = 1 << 24  #: to a nat; sums of whole units don't depend on the order of blocks


def least_count(tokens: int) -> int:
    """Occurrences in training of a word that is a symbol, and of a context, at least; the same for any number of tokens."""
    return LEAST


@dataclass
class Words:
    """A block's words: hash of each, first word of each text, whether the text is held out, whether it is learned from."""

    hashes: np.ndarray
    rows: np.ndarray
    held_out: np.ndarray
    learned: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Words:
        data, offsets = text_buffer(table.column("text"))
        data = np.frombuffer(LOWER, np.uint8)[data]
        starts, ends, rows = word_bounds(data, offsets)
        fold = np.array([-1 if k is None else zlib.crc32(str(k).encode()) % FOLDS for k in table.column("doc_id").to_pylist()], np.int64)
        return cls(span_hashes(data, starts, ends), rows, fold == 0, fold > 0)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


@dataclass
class Totals:
    """Counts over all training texts: tokens, distinct tokens, texts (ends); occurrences and number of the frequent words; the least count of these. split: places of a context for each bucket."""

    tokens: int
    types: int
    ends: int
    often: int
    symbols: int
    least: int
    split: int = SPLIT

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Probability of a word of so many occurrences, apart from any context."""
        return (counts + PRIOR) / (self.tokens + PRIOR * (self.types + 1))

    def rare(self) -> float:
        known = self.often + self.ends + PRIOR * (self.symbols + 1)
        return max(1e-12, 1 - known / (self.tokens + PRIOR * (self.types + 1)))


@dataclass
class Sequences:
    """A block's texts as symbols, each text after its start and before its end; places are those of words and ends."""

    lengths: np.ndarray  # words of each text
    words: np.ndarray  # numbers of the words among the block's distinct ones
    counts: np.ndarray  # of each distinct word, in training
    totals: Totals
    symbols: np.ndarray
    places: np.ndarray
    text: np.ndarray  # of each place
    learned: np.ndarray  # of each place
    ids: np.ndarray  # of each symbol, ascending: its number among all blocks' symbols
    often: np.ndarray  # of each symbol, its count in training
    root: np.ndarray  # probability of each symbol apart from any context

    @classmethod
    def of(cls, row: dict, told: dict[tuple[int, int], dict[int, bytes]], totals: Totals, buckets: int) -> Sequences:
        learned, distinct = np.frombuffer(row["learned"], bool), np.frombuffer(row["hashes"], np.uint64)
        n = _unpacked(row["lengths"], len(learned))
        words = _unpacked(row["words"], int(n.sum()))
        counts, ids = np.zeros((2, len(distinct)), np.int64)
        for b, at, _ in _split(WORDS, distinct, buckets):
            counts[at], rank = _unbundled(told[0, WORDS][b])
            ids[at[counts[at] >= totals.least]] = FIRST + rank * buckets + b
        high = np.flatnonzero(counts >= totals.least)
        high = high[np.argsort(ids[high])]
        number = np.full(len(distinct), RARE)
        number[high] = FIRST + np.arange(len(high))
        root = np.concatenate([[totals.rare(), float(totals.base(np.array(totals.ends))), 0.0], totals.base(counts[high])])
        begin = np.concatenate([[0], np.cumsum(n + DEPTH + 1)])
        # Before the start stand rare symbols, which no context may hold.
        out = np.full(begin[-1], RARE, np.int64)
        text = np.repeat(np.arange(len(n)), n)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        out[begin[:-1] + DEPTH - 1] = START
        out[begin[:-1][text] + DEPTH + np.arange(len(text)) - first[text]] = number[words]
        out[begin[1:] - 1] = END
        owner = np.repeat(np.arange(len(n)), n + 1)
        places = begin[:-1][owner] + DEPTH + np.arange(len(owner)) - (first + np.arange(len(n)))[owner]
        return cls(n, words, counts, totals, out, places, owner, learned[owner], np.concatenate([[RARE, END, START], ids[high]]), np.concatenate([[0, totals.ends, totals.ends], counts[high]]), root)

    def apart(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is known of each text without contexts: its known tokens, its base score, and its rare words' parts of the rare symbol's probability, whatever the context."""
        n, text = len(self.lengths), np.repeat(np.arange(len(self.lengths)), self.lengths)
        counts = self.counts[self.words]
        base, rare = np.log10(self.totals.base(counts)), counts < self.totals.least
        known = np.bincount(text, counts > 0, minlength=n).astype(np.int64) + (self.totals.ends > 0)
        own = np.bincount(text[rare], base[rare] - math.log10(self.root[RARE]), minlength=n)
        return known, np.bincount(text, base, minlength=n) + math.log10(self.root[END]), own

    def levels(self, p: np.ndarray, told: dict[tuple[int, int], dict[int, bytes]], turn: int, buckets: int):
        """The Level of each depth that a turn knows. p, the places' probabilities by their root, takes on those of longer kept contexts as the levels go by.

        A turn knows the counts of pairs for depths below its number, and the kept contexts of depths below the one before.
        """
        at, last, wide = np.arange(len(self.places)), self.symbols[self.places], len(self.ids)
        ids, often, own = self.ids, self.often, None
        for d in range(1, min(turn, DEPTH) + 1):
            ok = self.symbols[self.places[at] - d] != RARE
            if d == 1:
                context = self.symbols[self.places - 1]
            else:
                # A context is the pair one place before, and occurs as often.
                context = own[at - 1]
                ok &= (context >= 0) & (often[context] >= self.totals.least)
            at, context = at[ok], context[ok]
            distinct, pair = np.unique(context * wide + last[at], return_inverse=True)
            used = np.bincount(context, minlength=len(ids)) > 0
            number = np.cumsum(used) - 1
            level = Level(d, at, number[context], ids[used], often[used], pair, number[distinct // wide], self.ids[distinct % wide])
            if d < turn:
                level.hear(told.get((d, PAIRS), {}), self.totals, buckets)
            yield level
            if d >= turn:
                return
            if d < turn - 1:
                kept = level.kept(told.get((d, CONTEXTS), {}), buckets)[level.context]
                here = at[kept]
                p[here] = (level.counts[pair[kept]] + SMOOTHING * p[here]) / (level.often[level.context[kept]] + SMOOTHING)
            ids, often = level.own, level.counts
            own = np.full(len(self.places), -1)
            own[at] = pair


@dataclass
class Level:
    """A block's places whose context has so many symbols and may be kept: numbers of the places, of their contexts and of their pairs with the next symbol. Of contexts and of next symbols, their numbers among all blocks' ones.

    Of pairs, once known: counts in training, numbers as contexts of those that may be some, and whether this block is the one that counts the pair as a distinct one.
    """

    depth: int
    at: np.ndarray
    context: np.ndarray
    ids: np.ndarray  # of each context
    often: np.ndarray  # of each context, its count in training
    pair: np.ndarray
    of: np.ndarray  # context of each pair
    nexts: np.ndarray  # next symbol of each pair
    counts: np.ndarray | None = None
    own: np.ndarray | None = None
    first: np.ndarray | None = None

    def pairs_dealt(self, totals: Totals, buckets: int):
        """Each bucket, the pairs that go there, in order, and their keys: contexts in steps, the number of pairs of each, their next symbols in steps."""
        rank, bucket, key = self.ids // buckets, self.ids % buckets, self.ids // buckets
        # Pairs of a context stand together and ascend, so contexts are sorted, not pairs.
        sizes, order = np.bincount(self.of, minlength=len(self.ids)), np.arange(len(self.of))
        begins = np.cumsum(sizes) - sizes
        parts = 1 + np.maximum(self.often - 1, 0) // totals.split
        if (parts > 1).any():
            # All blocks know the same count of a context, so they deal it alike.
            whole, many = np.flatnonzero(parts == 1), np.flatnonzero((parts > 1)[self.of])
            shift = (mixed(self.nexts[many].astype(np.uint64)) % parts[self.of[many]].astype(np.uint64)).astype(np.int64) % buckets
            by = np.lexsort((shift, self.of[many]))
            many, shift, of = many[by], shift[by], self.of[many[by]]
            cuts = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(shift, prepend=-1))
            shift, of = shift[cuts], of[cuts]
            begins = np.concatenate([begins[whole], len(order) + cuts])
            sizes = np.concatenate([sizes[whole], np.diff(cuts, append=len(many))])
            key = np.concatenate([rank[whole], (shift << STEP_BITS) + rank[of]])
            bucket = np.concatenate([bucket[whole], (bucket[of] + shift) % buckets])
            order = np.concatenate([order, many])
        by = np.lexsort((key, bucket))
        bucket, key, begins, sizes = bucket[by], key[by], begins[by], sizes[by]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        order = order[np.repeat(begins - starts, sizes) + np.arange(len(self.of))]
        nexts = self.nexts[order]
        steps = np.diff(nexts, prepend=0)
        steps[starts] = nexts[starts]
        for b, lo, hi in _runs(bucket):
            places = slice(starts[lo], ends[hi - 1])
            yield b, order[places], (np.diff(key[lo:hi], prepend=0), sizes[lo:hi], steps[places])

    def contexts_dealt(self, buckets: int):
        """Each bucket, the contexts that go there, in order, and their keys in steps."""
        rank, bucket = self.ids // buckets, self.ids % buckets
        order = np.lexsort((rank, bucket))
        for b, lo, hi in _runs(bucket[order]):
            yield b, order[lo:hi], np.diff(rank[order[lo:hi]], prepend=0)

    def hear(self, told: dict[int, bytes], totals: Totals, buckets: int) -> None:
        """Takes on what the buckets say of the pairs."""
        self.counts, self.own = np.zeros((2, len(self.of)), np.int64)
        self.first = np.zeros(len(self.of), bool)
        for b, at, _ in self.pairs_dealt(totals, buckets):
            n, rank = _unbundled(told[b])
            self.counts[at], self.first[at] = n >> 1, n & 1
            if self.depth < DEPTH:
                self.own[at[n >> 1 >= totals.least]] = rank * buckets + b

    def kept(self, told: dict[int, bytes], buckets: int) -> np.ndarray:
        """Which contexts the buckets keep."""
        out = np.zeros(len(self.ids), bool)
        for b, at, _ in self.contexts_dealt(buckets):
            out[at] = _unbundled(told[b])[0]
        return out


WORDS, PAIRS, CONTEXTS = 0, 1, 2
KEY_BITS = 48  #: of a pair's hash within a bucket; a bucket's size doesn't grow, so neither do chances of two pairs with one key, some 1e-8


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of at least 0 in as few bytes each as hold them all."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(numbers, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = len(data) // n
        out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.reshape(-1).view(np.int64)


def _bundled(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of at least 0, compressed: byte by byte of all numbers, so that high bytes, mostly 0, take little."""
    widths = [max(1, (int(x.max(initial=0)).bit_length() + 7) // 8) for x in arrays]
    planes = [np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for x, w in zip(arrays, widths, strict=True)]
    data = b"".join([bytes([len(arrays), *widths]), np.array([len(x) for x in arrays], np.uint32).tobytes(), *planes])
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unbundled(bundle: bytes) -> list[np.ndarray]:
    data = pa.decompress(bundle[4:], int.from_bytes(bundle[:4], "little"), codec="zstd", asbytes=True)
    k = data[0]
    at, out = 1 + 5 * k, []
    for width, n in zip(data[1 : 1 + k], np.frombuffer(data, np.uint32, k, 1 + k).tolist(), strict=True):
        numbers = np.zeros((n, 8), np.uint8)
        numbers[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(numbers.reshape(-1).view(np.int64))
        at += n * width
    return out


def _runs(ordered: np.ndarray):
    """Each value of an ascending array, the first place that has it and the one after the last."""
    own, cuts = np.unique(ordered, return_index=True)
    yield from zip(own.tolist(), cuts.tolist(), [*cuts.tolist(), len(ordered)][1:], strict=True)


def _split(kind: int, hashes: np.ndarray, buckets: int):
    """Each bucket of some hashes, the places that have it, and their keys: those of pairs ascend and are packed as steps."""
    bucket = mixed(hashes) % np.uint64(buckets)
    if kind != PAIRS:
        for b, at in shares(bucket.astype(np.int64)):
            yield b, at, hashes[at].tobytes()
        return
    key = hashes >> np.uint64(64 - KEY_BITS)
    order = np.argsort(bucket << np.uint64(KEY_BITS) | key)
    own, cuts = np.unique(bucket[order], return_index=True)
    for b, lo, hi in zip(own.tolist(), cuts.tolist(), np.append(cuts, len(order))[1:].tolist(), strict=True):
        at = order[lo:hi]
        yield b, at, _packed(np.diff(key[at], prepend=np.uint64(0)))


_CODED = "block long, doc_ids array<{key}>, held_out array<boolean>, learned binary, lengths binary, words binary, hashes binary, tokens long, ends long"


def _parts(spark: SparkSession, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))


def _by_block(df: DataFrame, parts: int, name: str) -> DataFrame:
    """The table of that name with df's rows added, in partitions by block, so that no turn shuffles it again."""
    spark = df.sparkSession
    df.write.mode("append").bucketBy(parts, "block").option("path", f"{scratch_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def _coded(blocked: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """A row a block: its texts as numbers of its distinct words."""

    def code(table: pa.Table) -> pa.Table:
        w = Words.of(table)
        distinct, inverse = np.unique(w.hashes, return_inverse=True)
        n = np.diff(w.rows).astype(np.int64)
        row = [table.column("block")[0].as_py(), table.column("doc_id").to_pylist(), w.held_out.tolist(), w.learned.tobytes(), _packed(n), _packed(inverse), distinct.tobytes(), int(n[w.learned].sum()), int(w.learned.sum())]
        kinds = [pa.int64(), pa.list_(table.schema.field("doc_id").type), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in _CODED.split(", ")])

    return _by_block(blocked.groupBy("block").applyInArrow(code, _CODED.format(key=key)), parts, name)


def _told(table: pa.Table) -> dict[tuple[int, int], dict[int, bytes]]:
    out: dict[tuple[int, int], dict[int, bytes]] = {}
    for depth, kind, bucket, data in zip(*(table.column(c).to_pylist() for c in ("depth", "kind", "bucket", "data")), strict=True):
        out.setdefault((depth, kind), {})[bucket] = data
    return out


_ASKED = "depth int, kind int, bucket long, block long, data binary"
_ANSWERED = "depth int, kind int, bucket long, block long, data binary, types long, symbols long, often long"


def _asked_words(coded: DataFrame, buckets: int) -> DataFrame:
    """A row for each block and bucket: distinct words with their counts in the block's training texts."""

    def ask(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                learned, hashes = np.frombuffer(row["learned"], bool), np.frombuffer(row["hashes"], np.uint64)
                lengths = _unpacked(row["lengths"], len(learned))
                n = np.bincount(_unpacked(row["words"], int(lengths.sum())), np.repeat(learned, lengths), minlength=len(hashes)).astype(np.int64)
                # A block's distinct words ascend.
                rows += [(0, WORDS, b, row["block"], _bundled(np.diff(hashes[at], prepend=np.uint64(0)), n[at])) for b, at, _ in _split(WORDS, hashes, buckets)]
            yield from _arrow(rows, _ASKED).to_batches()

    return coded.select("block", "learned", "lengths", "words", "hashes").mapInArrow(ask, _ASKED)


def _asked(coded: DataFrame, answers: DataFrame, turn: int, totals: Totals, buckets: int) -> DataFrame:
    """A row for each block, bucket and kind: distinct pairs of depth `turn` with their counts in the block's training texts, and contexts of the depth before with their counts, sums of log(count / probability) over places, and how many of their pairs the block counts as distinct."""

    def ask(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        for row in table.to_pylist():
            have = _told(told)
            s = Sequences.of(row, have, totals, buckets)
            p = s.root[s.symbols[s.places]]
            for level in s.levels(p, have, turn, buckets):
                learned = s.learned[level.at]
                if level.depth == turn:
                    n = np.bincount(level.pair, learned, minlength=len(level.of)).astype(np.int64)
                    rows += [(turn, PAIRS, b, row["block"], _bundled(*keys, n[at])) for b, at, keys in level.pairs_dealt(totals, buckets)]
                elif level.depth == turn - 1:
                    context, n = level.context[learned], level.counts[level.pair[learned]]
                    wide = len(level.ids)
                    gain = np.bincount(context, np.rint(UNITS * np.log(n / p[level.at[learned]])), minlength=wide).astype(np.int64)
                    met, kinds = np.bincount(context, minlength=wide), np.bincount(level.of[level.first & (level.counts > 0)], minlength=wide)
                    rows += [(turn - 1, CONTEXTS, b, row["block"], _bundled(keys, met[at], gain[at], kinds[at])) for b, at, keys in level.contexts_dealt(buckets)]
        return _arrow(rows, _ASKED)

    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, _ASKED)


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _answered(asked: DataFrame, least: int, parts: int, name: str) -> DataFrame:
    """The table of answers with one more: for each row asked its words' or pairs' counts over all blocks, with the numbers of frequent ones, or which of its contexts are kept."""

    def add(table: pa.Table) -> pa.Table:
        kind, depth = table.column("kind")[0].as_py(), table.column("depth")[0].as_py()
        asked = [_unbundled(x) for x in table.column("data").to_pylist()]
        keys, counts = [np.cumsum(x[0]) for x in asked], [x[3 if kind == PAIRS else 1] for x in asked]
        sums = [np.concatenate([x[j] for x in asked]) for j in (2, 3)] if kind == CONTEXTS else []
        if kind == PAIRS:
            context, nexts = np.unique(np.concatenate(keys), return_inverse=True)[1], []
            each = np.concatenate([x[1] for x in asked])
            for _, n, steps, _ in asked:
                # Steps begin anew with each context.
                at = np.cumsum(steps)
                starts = np.cumsum(n) - n
                nexts.append(at - np.repeat(at[starts] - steps[starts], n))
            nexts = np.concatenate(nexts)
            keys = np.repeat(context, each) * (int(nexts.max(initial=0)) + 1) + nexts
        else:
            keys = np.concatenate(keys)
        cuts = np.cumsum([0, *map(len, counts)])
        del asked
        _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        high = total >= least
        columns = list(zip(*(table.column(c).to_pylist() for c in ("depth", "kind", "bucket", "block")), cuts[:-1], cuts[1:], strict=True))
        if kind == CONTEXTS:
            gain, k = np.bincount(inverse, sums[0]) / UNITS, np.bincount(inverse, sums[1])
            # Twice count times divergence is about chi-squared with the number of next symbols for its degrees of freedom.
            kept = high & (2 * (gain - total * np.log(np.maximum(total, 1))) >= k + 4 * np.sqrt(2 * k))
            back = kept[inverse].astype(np.int64)
            return _arrow([(*names, _bundled(back[lo:hi]), None, None, None) for *names, lo, hi in columns], _ANSWERED)
        rank = np.zeros(len(total), np.int64)
        rank[np.flatnonzero(high)[np.argsort(-total[high], kind="stable")]] = np.arange(high.sum())
        back, ranks, often = total[inverse], rank[inverse], high[inverse]
        if kind == PAIRS:
            back *= 2
            back[index] += 1
            often &= depth < DEPTH
        rows = [(*names, _bundled(back[lo:hi], ranks[lo:hi][often[lo:hi]]), None, None, None) for *names, lo, hi in columns]
        if kind == WORDS:
            rows[0] = (*rows[0][:5], int((total > 0).sum()), int(high.sum()), int(total[high].sum()))
        return _arrow(rows, _ANSWERED)

    return _by_block(asked.groupBy("depth", "kind", "bucket").applyInArrow(add, _ANSWERED).repartition(parts, "block"), parts, name)


def scored(docs: DataFrame, tree: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text; log10 probabilities.

    Learns from texts whose crc32(doc_id as text) mod 10 is not 0. Null and empty texts are one end token.
    Rows of a null doc_id are scored but neither held out nor learned from; a repeated row counts again.
    A text of any length is read whole, but must fit in a task's memory. Without training texts both scores
    are 0. An empty table gives no rows; other columns are ignored, whatever their names.
    Without tree no contexts are counted, and score is that of the symbols apart from any; the other columns don't depend on it.
    """
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    blocked, _, size = in_blocks(docs, BLOCK_BYTES)
    buckets = max(1, math.ceil(size / 4 / BUCKET_BYTES))
    blocked = dealt(blocked, "block", size)
    parts = _parts(spark, size)
    coded_name, name = (f"{x}_{uuid.uuid4().hex}" for x in ("coded", "answers"))
    try:
        coded = _coded(blocked, key, parts, coded_name)
        total = lambda name: F.coalesce(F.sum(name), F.lit(0))
        words, ends = coded.agg(total("tokens"), total("ends")).first()
        least = least_count(words + ends)
        answers = _answered(_asked_words(coded, buckets), least, parts, name)
        types, symbols, often = answers.agg(total("types"), total("symbols"), total("often")).first()
        totals = Totals(words + ends, types + (1 if ends else 0), ends, often, symbols, least, SPLIT)
        turns = DEPTH + 2 if tree else 0
        for turn in range(1, turns):
            answers = _answered(_asked(coded, answers, turn, totals, buckets), least, parts, name)
    finally:
        for x in (coded_name, name):  # the catalogue forgets the names, the files stay
            spark.sql(f"DROP TABLE IF EXISTS {x}")

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        for row in table.to_pylist():
            have = _told(told)
            s = Sequences.of(row, have, totals, buckets)
            p = s.root[s.symbols[s.places]]
            for _ in s.levels(p, have, turns, buckets):
                pass
            known, base, own = s.apart()
            logs = np.bincount(s.text, np.log10(p), minlength=len(s.lengths)) + own
            columns = (row["doc_ids"], row["held_out"], (s.lengths + 1).tolist(), known.tolist(), base.tolist(), logs.tolist())
            for have_, more in zip(out, columns, strict=True):
                have_ += more
        if not totals.tokens:
            out[4] = out[5] = [0.0] * len(out[0])
        kinds = [table.schema.field("doc_ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        a = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        return pa.table([*a[:4], pa.array(np.full(len(a[0]), totals.tokens)), *a[4:]], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of query() that SQL can state: all but the tree's score, so without a tree."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), tree=False).withColumn("base_score", F.round("base_score", 5) + F.lit(0.0)).drop("score")


#: The long expression is crc32 of the decimal doc_id, bit by bit.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 10 = 0 AS held_out,
  list_append(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: 'w' || w), 'end') AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 5) + 0.0 AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""
