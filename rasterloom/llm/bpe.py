"""Byte-level BPE encoding and decoding with a public vocabulary, through an index of pair occurrences.

Texts are cut into pieces; each process keeps the ids of the pieces it has met. Pieces that are new in a
chunk of a partition are laid out in one array of symbols, with an index from each pair of neighbouring
symbols to all its positions. Active pairs are applied in ascending order of rank: every occurrence is
merged, and the lists of the pairs that it touches are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import slices, span_hashes

#: Fixed value: the split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A process forgets its pieces when it holds this many; they are then encoded anew, with the same result.
PIECES_HELD = 400_000
#: Bytes of text that are cut and merged together.
CHUNK_BYTES = 4 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 4, 8


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file, given as its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        bytes_of = {letter: b for b, letter in byte_letters().items()}
        ids = spec["model"]["vocab"]
        self.letter_array = np.array([ids[letter] for _, letter in sorted(byte_letters().items())])
        self.bytes_of = {i: bytes(bytes_of[c] for c in word) for word, i in ids.items()}
        self.rules = []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rules.append((ids[a], ids[b], ids[a + b]))
        self.span = 1 + max(ids.values())
        keys = np.array([a * self.span + b for a, b, _ in self.rules], np.int64)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: word.encode() for word, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)

    def pieces(self, text: str) -> list[str]:
        """The text cut by the pattern; special tokens stand alone, before any other cut."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def merged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[offsets[k]:offsets[k + 1]] one after the other, and how many each piece has.

        The index maps a rank to the positions where its pair occurs. Every new pair that a merge makes
        ranks after that merge, so taking active ranks in ascending order gives each piece its own order.
        """
        symbols = self.letter_array[data].astype(np.int64)
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        lasts, firsts = offsets[1:][np.diff(offsets) > 0] - 1, offsets[:-1][np.diff(offsets) > 0]
        after[lasts], before[firsts] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            keys = left * self.span + right
            at = np.searchsorted(self.keys, keys)
            known = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
            if not len(known):
                return
            ranks = self.ranks[at[known]]
            order = np.argsort(ranks, kind="stable")
            ranks, spots = ranks[order], positions[known[order]]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lo = 0
            for hi in [*cuts.tolist(), len(ranks)]:
                rank = int(ranks[lo])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(spots[lo:hi])
                lo = hi

        first = np.flatnonzero(after >= 0)
        note(first, symbols[first], symbols[after[first]])
        while active:
            rank = heapq.heappop(active)
            spots = index.pop(rank)
            at = spots[0] if len(spots) == 1 else np.unique(np.concatenate(spots))
            a, b, made = self.rules[rank]
            nxt = after[at]
            ok = (symbols[at] == a) & (nxt >= 0)
            ok &= symbols[nxt] == b  # of nxt == -1 the last symbol is read, and not used
            if not ok.all():
                at, nxt = at[ok], nxt[ok]
            if not len(at):
                continue
            if a == b:  # a run of equal symbols is paired off from its start
                keep, used = [], -1
                for k, (x, y) in enumerate(zip(at.tolist(), nxt.tolist(), strict=True)):
                    if x != used:
                        keep.append(k)
                        used = y
                at, nxt = at[keep], nxt[keep]
            symbols[at], symbols[nxt] = made, -1
            beyond, prior = after[nxt], before[at]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            had = prior >= 0
            left, right = np.concatenate([at[has], prior[had]]), np.concatenate([beyond[has], at[had]])
            if len(left):
                note(left, symbols[left], symbols[right])
        alive = symbols >= 0
        counts = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=counts[1:])
        return symbols[alive], counts[offsets[1:]] - counts[offsets[:-1]]

    def decode(self, ids) -> str:
        """The text of ids; those that the vocabulary lacks are left out, and bytes that aren't UTF-8 become replacement characters."""
        return b"".join([self.bytes_of[i] for i in ids if i in self.bytes_of]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """Of each code point: a letter, a number, white space or other, by the regular expressions of PATTERN."""
    out = np.full(0x110000, OTHER, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(lo, hi)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[lo + m.start() : lo + m.end()] = kind
    return out


def cut(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """First characters of the pieces of PATTERN. points: the texts' code points, one text after the other; rows: each text's first character, and the end."""
    n = len(points)
    kinds = character_kinds()[points]
    fresh = np.zeros(n + 1, bool)  # where a text begins, or all texts end
    fresh[rows] = True
    begins = fresh[:n].copy()
    begins[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == SPACE
    # The last character of a run of white space stands apart, unless the text ends with the run; a plain blank joins what follows.
    ends = np.ones(n, bool)
    ends[:-1] = kinds[1:] != kinds[:-1]
    tail = np.flatnonzero(blank & ends & ~fresh[1:])
    begins[tail] = True
    begins[tail[points[tail] == 32] + 1] = False
    # A contraction needs an apostrophe that no earlier piece has taken.
    quote = np.flatnonzero((points == 39) & begins[:n])
    for letters in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        k = len(letters)
        at = quote[quote + k < n]
        ok = np.ones(len(at), bool)
        for j, letter in enumerate(letters, 1):
            ok &= (points[at + j] == letter) & ~fresh[at + j]
        at = at[ok]
        begins[at + 1] = False
        past = at + k + 1
        begins[past[past < n]] = True
    return np.flatnonzero(begins)


class Coder:
    """A process's encoder: the pieces met so far by hash, with their ids, those ids as decimal text, and what they decode to."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.digits: list[str] = []
        self.plain: list[str] = []

    def numbers(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number under which each piece is held; pieces not met before are encoded first, all together."""
        if len(self.digits) > PIECES_HELD:
            self.forget()
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = self.hashes[np.minimum(at, max(0, len(self.hashes) - 1))] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        if len(new):
            lengths = (ends - starts)[first[new]]
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            flat = data[np.repeat(starts[first[new]] - offsets[:-1], lengths) + np.arange(offsets[-1])]
            ids, counts = self.vocabulary.merged(flat, offsets)
            bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
            ids, bytes_of = ids.tolist(), self.vocabulary.bytes_of
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                self.digits.append(",".join(map(str, ids[lo:hi])))
                self.plain.append(b"".join([bytes_of[i] for i in ids[lo:hi]]).decode("utf-8", "replace"))
            place = np.searchsorted(self.hashes, distinct[new])
            self.hashes = np.insert(self.hashes, place, distinct[new])
            self.order = np.insert(self.order, place, len(self.digits) - len(new) + np.arange(len(new)))
        return self.order[np.searchsorted(self.hashes, distinct)][inverse]

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids in decimal, joined by commas, and the text that they decode to.

        Pieces are held by a 64-bit hash. A text that doesn't decode to itself, as two pieces of one hash
        would make it, is encoded again piece by piece; so is one with special tokens.
        """
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        firsts = cut(points, rows)
        sizes = np.ones(len(points), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            sizes += points >= limit
        place = np.concatenate([[0], np.cumsum(sizes)])
        starts = place[firsts]
        ends = np.append(starts[1:], len(data))
        held = self.numbers(span_hashes(data, starts, ends), data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        cuts = np.searchsorted(firsts, rows).tolist()
        held, digits, plain = held.tolist(), self.digits.__getitem__, self.plain.__getitem__
        special, out = self.vocabulary.special_pattern, []
        for text, lo, hi in zip(texts, cuts[:-1], cuts[1:], strict=True):
            decoded = "".join(map(plain, held[lo:hi]))
            if decoded != text or special is not None and special.search(text):
                out.append(self.encode_alone(text))
            else:
                out.append((",".join(map(digits, held[lo:hi])), decoded))
        return out

    def encode_alone(self, text: str) -> tuple[str, str]:
        v, ids = self.vocabulary, []
        for piece in v.pieces(text):
            if piece in v.special:
                ids.append(v.special[piece])
            else:
                data = piece.encode("utf-8", "replace")
                ids += v.merged(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()
        return ",".join(map(str, ids)), v.decode(ids)


@lru_cache(maxsize=1)
def _coder(text: str) -> Coder:
    return Coder(Vocabulary(text))


def _apply(docs: DataFrame, vocabulary: str, key: str, text: str, columns: list[tuple[str, pa.DataType, str]], of) -> DataFrame:
    """key and what `of(digits, decoded)` returns for each text. The vocabulary's text, of a size known beforehand, goes to the executors in one broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["key", *(name for name, _, _ in columns)]

    def run(batches):
        coder = _coder(shared.value)
        for batch in slices(batches, "text", CHUNK_BYTES):
            found = zip(*(of(*pair) for pair in coder.encode([t or "" for t in batch.column("text").to_pylist()])), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(v, kind) for v, (_, kind, _) in zip(found, columns, strict=True))], names)

    schema = ", ".join([f"key {docs.schema[key].dataType.simpleString()}", *(f"{name} {sql}" for name, _, sql in columns)])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of each whole text. vocabulary: the JSON text of a byte-level BPE file.

    The strings of special tokens become their ids. A null text counts as empty and has no ids; rows
    whose key repeats or is null are each encoded. An empty table gives no rows; other columns are ignored, whatever their names. A text of any length is read whole, but must fit in a task's memory.
    """
    return _apply(docs, vocabulary, key, text, [("ids", pa.list_(pa.int32()), "array<int>")], lambda digits, _: ([int(i) for i in digits.split(",") if i],))


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of each list of ids; a null list gives the empty text, and ids that are null or that the vocabulary lacks are left out, as the public library does. Lists of any length are decoded whole."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = _coder(shared.value).vocabulary
        for batch in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([v.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())], ["key", "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {encoded.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def _digest(digits: str, decoded: str) -> tuple[int, str, str]:
    return digits.count(",") + 1 if digits else 0, hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each whole text in one pass: key, n_tokens, and SHA-256 of the ids (decimal, by commas) and of the decoded text.

    The decoded text comes from the ids: each piece's ids are turned into text once a process. Nulls, repeated and extra columns as in encode().
    """
    return _apply(docs, vocabulary, key, text, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], _digest)


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file's text, read on the driver; by default the installed public byte-level file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary_text())
