"""MATCH over an inverted index with positions.

The index is a table of one row for each term and document, stored in ranges of (term, document): a look-up reads
the few files whose bounds hold the term, and a term of very many documents is spread over many files and
tasks. A match expression becomes filters, joins and unions of postings on the document's key; no text is read again.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.stored import stored

#: A term: ASCII letters and digits, and all characters beyond ASCII; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms that may lie between the sides of a NEAR without a number.
NEAR = 10
_TOKEN = re.compile(r'\s*(?:(?P<phrase>"[^"]*")|(?P<near>NEAR(?:/\d+)?)(?![^\s()"])|(?P<op>AND|OR|NOT)(?![^\s()"])|(?P<mark>[()])|(?P<word>[^\s()"]+))')


class MatchError(ValueError):
    """Text that is not a match expression."""


def indexed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key and places (ascending, from 0) of every term of every document, stored in ranges of term and key.

    key names a row, as a primary key does; rows of a null key, and null and empty texts, have no entries. A document's
    entries are found in its own row, so what is shuffled is the entries, once, into their ranges.
    """
    kind = docs.schema[key].dataType.simpleString()
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    each = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), words.alias("words"))

    def gather(batches):
        for batch in batches:
            lists = batch.column("words")
            flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # Entries are runs of one term and document; rows of one term lie together and are packed well.
            term = coded.indices.to_numpy()
            order = np.lexsort((doc, term))
            term, doc, place = term[order], doc[order], place[order].astype(np.int32)
            entry = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            places = pa.ListArray.from_arrays(pa.array(np.append(entry, len(term)), pa.int32()), pa.array(place))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[entry])), batch.column("key").take(pa.array(doc[entry])), places], ["term", "key", "places"])

    rows = each.mapInArrow(gather, f"term string, key {kind}, places array<int>")
    return stored(rows.repartitionByRange("term", "key").sortWithinPartitions("term", "key"))


def terms(text: str) -> list[str]:
    return [t.translate(str.maketrans(UPPER, LOWER)) for t in re.findall(TERM, text)]


def _postings(index: DataFrame, term: str, prefix: bool) -> DataFrame:
    if not prefix:
        return index.where(F.col("term") == term).select("key", "places")
    # A range, so that files whose bounds lie outside it are skipped.
    own = index.where((F.col("term") >= term) & F.startswith("term", F.lit(term)))
    return own.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


def _phrase(index: DataFrame, text: str) -> tuple[DataFrame, int]:
    """key and the places where a phrase begins; its length. The last word may end in * and is then a prefix."""
    words = terms(text)
    if not words:
        raise MatchError(f"no term in {text!r}")
    out = None
    for k, word in enumerate(words):
        own = _postings(index, word, k == len(words) - 1 and text.rstrip('" ').endswith("*"))
        # Places of the k-th word, moved to where the phrase would begin.
        begun = own.select("key", _moved(-k).alias("own"))
        out = own if out is None else out.join(begun, "key").select("key", F.array_intersect("places", "own").alias("places")).where(F.size("places") > 0)
    return out, len(words)


def _moved(by: int):
    return F.transform("places", lambda p: p + F.lit(by))


class _Expression:
    """Reads a match expression: NOT binds tightest, then AND (also left out), then OR."""

    def __init__(self, index: DataFrame, text: str):
        self.index, self.at, self.tokens = index, 0, []
        place = 0
        while text[place:].strip():
            m = _TOKEN.match(text, place)
            if not m:
                raise MatchError(f"unexpected text at {place}: {text[place : place + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            place = m.end()

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise MatchError("the expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> DataFrame:
        sides = [self.both()]
        while self.peek() == ("op", "OR"):
            self.take()
            sides.append(self.both())
        return sides[0] if len(sides) == 1 else reduce(DataFrame.unionByName, sides).distinct()

    def both(self) -> DataFrame:
        out = self.without()
        while self.peek()[0] in ("phrase", "word") or self.peek() in (("mark", "("), ("op", "AND")):
            if self.peek() == ("op", "AND"):
                self.take()
            out = out.join(self.without(), "key", "left_semi")
        return out

    def without(self) -> DataFrame:
        out = self.near()
        while self.peek() == ("op", "NOT"):
            self.take()
            out = out.join(self.near(), "key", "left_anti")
        return out

    def near(self) -> DataFrame:
        kind, text = self.take()
        if (kind, text) == ("mark", "("):
            out = self.either()
            if self.take() != ("mark", ")"):
                raise MatchError("a parenthesis is open")
            return out
        if kind not in ("phrase", "word"):
            raise MatchError(f"expected a term, found {text!r}")
        left, size = _phrase(self.index, text)
        out = left.select("key")
        while self.peek()[0] == "near":
            number = self.take()[1].partition("/")[2]
            kind, text = self.take()
            if kind not in ("phrase", "word"):
                raise MatchError(f"NEAR needs terms or phrases, not {text!r}")
            right, other = _phrase(self.index, text)
            pair = left.withColumnRenamed("places", "a").join(right.withColumnRenamed("places", "b"), "key")
            close = _within("a", size, "b", number) | _within("b", other, "a", number)
            out = out.join(pair.where(close).select("key"), "key", "left_semi")
            left, size = right, other
        return out


def _within(first: str, size: int, second: str, number: str):
    """Whether something of `second` begins after the end of something of `first` with at most `number` terms between. Work goes with the places, not with their pairs."""
    ends = F.flatten(F.transform(first, lambda p: F.sequence(p + size, p + size + int(number or NEAR))))
    return F.arrays_overlap(ends, second)


def matching(index: DataFrame, expression: str) -> DataFrame:
    """key of each document that matches, once: terms, terms*, "phrases", "phrases*", a NEAR/n b, AND (or nothing between), OR, NOT, parentheses.

    NOT is "and not" and binds tightest, then AND, then OR; operators are in capitals. A word that holds other characters than a
    term's is a phrase of its terms. a NEAR/n b: at most n terms lie between, in either order; a NEAR b NEAR c asks both pairs.
    """
    e = _Expression(index, expression)
    out = e.either()
    if e.peek()[0] is not None:
        raise MatchError(f"unexpected {e.peek()[1]!r}")
    return out.select("key")
