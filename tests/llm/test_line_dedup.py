import random
from collections import defaultdict

import numpy as np
import pytest

from rasterloom.llm import line_dedup
from tests.llm.helpers import clashing, documents, prose, words


def kept(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_exact_lines_against_brute_force(spark):
    rng = random.Random(11)
    shared = [prose(rng, 12) for _ in range(6)] + [prose(rng, 4) for _ in range(3)] + ["one two"]
    rows = [(k, "\n".join(rng.choice(shared) if rng.random() < 0.4 else prose(rng, rng.randrange(1, 30), 10**5) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    where = defaultdict(set)
    for k, t in rows:
        for line in t.split("\n"):
            where[tuple(words(line))].add(k)

    def gone(k, line):
        n, at = len(words(line)), where[tuple(words(line))]
        return n >= 3 and len(at) >= (3 if n >= 8 else 10) and k != min(at)

    # Words of prose() hold digits; without them the templates are the lines themselves.
    spell = str.maketrans("0123456789", "abcdefghij")
    docs = documents(spark, [(k, t.translate(spell)) for k, t in rows])
    want = {k: "\n".join(x for x in t.split("\n") if not gone(k, x)).translate(spell) for k, t in rows}
    got = line_dedup.dedup(docs)
    assert kept(got) == want
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in got.collect()}
    assert lines == {k: (t.count("\n") + 1, sum(gone(k, x) for x in t.split("\n"))) for k, t in rows}


def test_variable_fields(spark):
    numbers = [(k, f"{'abcdefgh'[k] * 3} own words of a document that no other has\nOrder 12{k} was sent on 2024-01-0{k} to the given address") for k in range(5)]
    names = [(10 + k, f"Dear customer your parcel number was handed over to {n} at the front door today") for k, n in enumerate(("Ann", "Bob", "Cem", "Dan"))]
    other = [(20, "Dear customer your parcel is something else that has quite other words in it today too")]
    got = kept(line_dedup.dedup(documents(spark, numbers + names + other)))
    assert got[0] == numbers[0][1] and all(got[k] == numbers[k][1].split("\n")[0] for k in range(1, 5))
    assert got[10] == names[0][1] and [got[10 + k] for k in (1, 2, 3)] == ["", "", ""]
    assert got[20] == other[0][1]


def test_rows_of_numbers_stay(spark):
    rows = [(k, f"{k} {k + 1} {k * 7} 12 13 14 15 16 17") for k in range(20)]
    assert kept(line_dedup.dedup(documents(spark, rows))) == dict(rows)


def test_exact_rows_and_passages(spark):
    row, short, passage = "1 22 333 4444 5 66 777 8888 9 10", "7 8 9", "a passage of well over eight words that stands in two of the documents only"
    dated = "On 2024-01-0{} the order of the customer was sent to the given address"
    rows = [(k, "\n".join((f"{'abcdefghijkl'[k] * 4} own words", row if k < 3 else f"{k} 22 333 4444 5 66 777 8888 9 10", short))) for k in range(12)]
    rows += [(20, passage), (21, f"own line\n{passage}"), (22, passage.replace("two", "three")), (30, dated.format(1)), (31, dated.format(1)), (32, "x\n" + "other words here " * 3)]
    got = kept(line_dedup.dedup(documents(spark, rows)))
    want = dict(rows)
    for k in range(1, 12):
        want[k] = "\n".join(rows[k][1].split("\n")[: 1 if k < 3 else 2])
    want |= {21: "own line", 22: "", 31: ""}
    assert got == want


def test_two_alike_and_two_the_same(spark):
    """One line in two documents goes from the second; a variant that only one of these has stays."""
    a, b = "the same line in two documents is dropped from the later", "the same line in two documents is kept from the later"
    got = kept(line_dedup.dedup(documents(spark, [(1, f"{a}\n{b}"), (2, a)])))
    assert got == {1: f"{a}\n{b}", 2: ""}
    got = kept(line_dedup.dedup(documents(spark, [(1, a), (2, b)])))
    assert got == {1: a, 2: b}


def test_full_leaf(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAF", 3)
    rows = [(k, f"same three words then {'abcdefghijkl'[k]} and the same line to its very end here") for k in range(12)]
    got = kept(line_dedup.dedup(documents(spark, rows)))
    assert got == {k: t if k == 0 else "" for k, t in rows}  # parting a full leaf for work changes nothing


@pytest.mark.parametrize("leaf", [1, 3, 1000])
def test_leaf_size_changes_nothing(spark, monkeypatch, leaf):
    monkeypatch.setattr(line_dedup, "LEAF", leaf)
    near = [(k, f"same three words then {'abcdefghijkl'[k]} and the same line to its very end here") for k in range(12)]
    late = [(20 + k, f"same three words then all is alike but the last of it: {'abcd'[k]}") for k in range(4)]
    far = [(30 + k, f"same three words {' '.join(x * 3 for x in 'abcdefghijklmnopqr'[3 * k : 3 * k + 3])} and here it ends for good") for k in range(4)]
    got = kept(line_dedup.dedup(documents(spark, near + late + far)))
    want = dict(far) | {k: t if k in (0, 20) else "" for k, t in near + late}
    assert got == want


def test_links_against_all_pairs():
    rng = np.random.default_rng(12)
    for n, kinds in ((5, 3), (12, 2), (20, 2)):
        codes = rng.integers(-1, kinds, (60, n))
        root = list(range(60))
        for i in range(60):
            for j in range(i):
                if 5 * int(((codes[i] == codes[j]) & (codes[i] >= 0)).sum()) >= 4 * n:
                    a, b = root[i], root[j]
                    root = [min(a, b) if x in (a, b) else x for x in root]
        assert line_dedup._linked(codes).tolist() == root


def test_edges(spark):
    line = "a line of eight words that comes again"
    rows = [(1, line), (2, line + "\n"), (3, f"x\n{line}\n{line}"), (4, None), (5, ""), (None, line), (3, f"x\n{line}\n{line}")]
    for docs in (documents(spark, rows), clashing(spark, rows)):
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(docs).collect()), key=str)
        assert got == sorted([(1, line, 1, 0), (2, "", 2, 1), (3, "x", 3, 2), (3, "x", 3, 2), (4, None, 0, 0), (5, "", 1, 0), (None, line, 1, 0)], key=str)
    assert line_dedup.dedup(documents(spark, [])).count() == 0
