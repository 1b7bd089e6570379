import random
from collections import Counter

import numpy as np
import pyarrow as pa

from rasterloom.llm import decontaminate
from rasterloom.llm.common import span_hashes, text_buffer, word_bounds
from tests.llm.helpers import clashing, documents, lower, prose, words


def bags(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows, items):
    found = []
    for k, t in rows:
        w = words(lower(t))
        for j, text in items:
            v = words(lower(text))
            if not v:
                continue
            best, n = 0.0, 0
            for i in range(len(w) - len(v) + 1):
                x, y = bags(w[i : i + len(v)]), bags(v)
                s = sum((x & y).values()) / sum((x | y).values())
                if s >= 0.8:
                    n, best = n + 1, max(best, s)
            if n:
                found.append((k, j, n, round(best, 9)))
    return sorted(found, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    items = [(j, prose(rng, n, 10**4)) for j, n in enumerate((15, 20, 33, 60, 5, 8, 3, 1))] + [(20, "x y x y x y x y x y"), (21, ""), (22, None)]
    rows = []
    for k in range(60):
        text = items[rng.randrange(len(items))][1] or ""
        w = text.split()
        for _ in range(rng.randrange(3)):
            if w:
                w[rng.randrange(len(w))] = f"e{k}"
        part = " ".join(w)
        rows.append((k, f"{prose(rng, rng.randrange(60), 10**4)} {part.upper() if k % 5 == 0 else part}\n{prose(rng, rng.randrange(20), 10**4)}"))
    rows += [(100, None), (101, ""), (102, items[3][1] + " " + items[3][1]), (103, "x y " * 40), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(documents(spark, rows), benchmark).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_windows, round(r.similarity, 9)) for r in got), key=str) == brute(rows, items)


def brute_of_shorter(rows, items):
    """brute(), and texts shorter than an item as one window of their own size."""
    found = []
    for k, t in rows:
        for j, text in items:
            x, y = bags(words(lower(t))), bags(words(lower(text)))
            if x and len(words(t)) < len(words(text)):
                s = sum((x & y).values()) / sum((x | y).values())
                if s >= 0.8:
                    found.append((k, j, 1, round(s, 9)))
    return sorted(brute(rows, items) + found, key=str)


def test_truncated_items(spark):
    rng = random.Random(13)
    items = [(j, prose(rng, n, 10**4)) for j, n in enumerate((6, 9, 15, 33, 60, 60, 4))] + [(20, "x y x y x y x y x y x y")]
    rows = []
    for j, text in items:
        w = text.split()
        for lo in range(4):
            for hi in range(len(w) - 14, len(w) + 1):
                if lo < hi:
                    rows.append((len(rows), " ".join(w[lo:hi])))
        rows.append((len(rows), " ".join(["other", *w[1:-1]])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(documents(spark, rows), benchmark).collect()
    want = brute_of_shorter(rows, items)
    assert sorted(((r.doc_id, r.item_id, r.n_windows, round(r.similarity, 9)) for r in got), key=str) == want
    assert len(want) > len(brute(rows, items))
    assert next(r for r in got if rows[r.doc_id][1] == " ".join(items[4][1].split()[:50])).item_id == 4


def test_several_indexes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 100)
    rng = random.Random(9)
    items = [(j, prose(rng, 20)) for j in range(10)]
    rows = [(j, f"before {t} after") for j, t in items]
    got = decontaminate.matches(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(j, j) for j in range(10)]


def test_edges(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f", "x")], "item_id long, text string, key string")
    assert decontaminate.matches(documents(spark, [(1, "a b c d e f")]), empty).count() == 0
    assert decontaminate.matches(documents(spark, []), some).count() == 0
    assert decontaminate.matches(clashing(spark, [(1, "z a b c d e f"), (1, "z a b c d e f")]), some).count() == 2


def test_multi_index_against_all_pairs():
    """All fingerprints within the radius are found, and no others; of unrelated pairs hardly any is."""
    rng = random.Random(31)
    texts = [prose(rng, 40, 10**4) for _ in range(300)]
    index = decontaminate.Index.of(list(range(300)), texts)
    gen = np.random.default_rng(32)
    bits = np.unpackbits(index.prints.view(np.uint8), axis=1)
    near = [bits[k % 300] ^ (gen.permutation(256) < k % 80).astype(np.uint8) for k in range(600)]
    parts = np.packbits(np.array([*near, *gen.integers(0, 2, (400, 256), np.uint8)], np.uint8), axis=1).view(np.uint16)
    apart = np.bitwise_count(parts[:, None, :] ^ index.prints[None]).sum(axis=2)
    window, item = index.candidates(parts, 40)
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS)), strict=True))
    assert len(index.candidates(parts, 41)[0]) == 0 and (window >= 600).sum() == 0


def test_recall_of_fingerprints():
    """Of windows that are similar to 0.8 or a little more, the fingerprints of at least 99 % are within the radius."""
    rng = random.Random(33)
    found = total = 0
    for _ in range(150):
        w = prose(rng, 104, 10**6).split()
        v = list(w)
        v[50], v[20] = "changed", "changed"
        x, y = (decontaminate._shingles(span(t)) for t in (w, v))
        both = sum((Counter(x.tolist()) & Counter(y.tolist())).values())
        assert 0.8 <= both / (200 - both) < 0.83
        a, b = (np.packbits(decontaminate._bits(t).sum(axis=0) > 0) for t in (x, y))
        found += int(np.bitwise_count(a ^ b).sum()) <= decontaminate.RADIUS
        total += 1
    assert found >= 0.99 * total


def span(w):
    data, offsets = text_buffer(pa.array([" ".join(w)]))
    starts, ends, _ = word_bounds(data, offsets)
    return span_hashes(data, starts, ends)


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 64)
    rng = random.Random(34)
    items = [(0, prose(rng, 40, 10**4)), (1, prose(rng, 90, 10**4))]
    rows = [(0, " ".join(x for _ in range(6) for x in (prose(rng, 50, 10**4), items[0][1], prose(rng, 9, 10**4), items[1][1])))]
    got = decontaminate.matches(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_windows, round(r.similarity, 9)) for r in got), key=str) == brute(rows, items)
