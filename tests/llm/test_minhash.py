import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import minhash
from tests.llm.helpers import clashing, documents, lower, prose, varied, words


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    own = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((k, len(s), find(k), find(k) == k) for k, s in own)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [2, 8])
def test_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(4)
    texts = [t for _, t in varied(rng)]
    texts += family(rng, prose(rng, 300), 25, 3) + family(rng, prose(rng, 300), 25, 6) + family(rng, prose(rng, 60), 10, 1) + ["One two", "one TWO", "one two three", "A b c d e f g h i j", "a b c d e f g h i j"]
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_later_rounds_against_brute_force(spark, monkeypatch):
    """Families round several texts, and texts that are parts of others, in rounds of hubs down to groups of two."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "SMALL_LATER", 4)
    rng, percent = random.Random(8), 60
    one, two = prose(rng, 120, 10**6), prose(rng, 60, 10**6)
    texts = [f"{one} {two}", *family(rng, one, 5, 2), *family(rng, one, 5, 5), *family(rng, f"{one} {two}", 5, 3), *family(rng, two, 5, 1)]
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(documents(spark, rows), percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows, percent)


def test_chain(spark):
    """Each text is linked with the next only, so the component is found by walking."""
    rng = random.Random(5)
    w = prose(rng, 420).split()
    rows = [(100 - k, " ".join(w[10 * k : 10 * k + 200])) for k in range(20)]
    got = minhash.near_duplicates(documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {r.component_id for r in got} == {81}


def test_edges(spark):
    got = minhash.near_duplicates(clashing(spark, [(None, "a b"), (None, "a b"), (1, ""), (2, None), (3, "a b"), (3, "a b"), (4, " \n")])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter({(None, None, True): 2, (1, 1, True): 1, (2, 2, True): 1, (3, 3, True): 2, (4, 4, True): 1})
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    got = minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_signatures_estimate_similarity():
    rng = random.Random(7)
    close = defaultdict(list)
    for edits in (2, 12):
        for _ in range(20):
            base = prose(rng, 250, 10**6)
            hashes, firsts = minhash.shingle_sets(pa.array([base, family(rng, base, 1, edits)[0]]))
            keys = minhash.circulant_bands(hashes, firsts)
            close[edits].append(float((keys[0] == keys[1]).mean()))
    assert np.mean(close[2]) > 0.55 > 0.35 > np.mean(close[12])


def test_sets_without_a_sort_by_two_keys(monkeypatch):
    """Texts' shingles are sorted text by text; a sort of a whole slice by text and hash took half the time of the sets."""
    monkeypatch.setattr(np, "lexsort", None)
    texts = ["", None, "A", "a b c d", "a b c d e A B C D E f", "   ", prose(random.Random(3), 400, 20), "d c b a", "a b c d"]
    hashes, firsts = minhash.shingle_sets(pa.array(texts))
    sets = [hashes[lo:hi] for lo, hi in zip(firsts[:-1], firsts[1:], strict=True)]
    assert [len(x) for x in sets] == [len(shingles(t)) for t in texts]
    assert all((x[1:] > x[:-1]).all() for x in sets) and (sets[3] == sets[8]).all() and sets[3] != sets[7]
