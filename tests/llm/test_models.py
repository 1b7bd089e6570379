"""Toxicity and the suffix tree: gradients by differences, held-out accuracy, sums of probabilities, edges."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import suffix_tree_lm as lm
from rasterloom.llm import toxicity
from tests.llm.helpers import clashing, documents, lower, prose, words

DATA = "/root/testdata/sf0.1"


def test_gradients():
    rng = np.random.default_rng(1)
    t = toxicity.read(pa.array(["one two three four", "five six two", "seven one one eight nine"]))
    net = toxicity.Network.new(np.sort(t.hashes[:4]), rng)
    for name in net.weights:
        net.weights[name] = net.weights[name].astype(np.float64)
    text, first, size = toxicity.windows_of(t.rows)
    y = np.array([1.0, 0, 1])

    def loss():
        odds = net.forward(net.inputs(t), *net.windows(t, None, first, size))
        return float((np.log1p(np.exp(odds)) - y * odds).sum())

    words_, live = net.windows(t, None, first, size)
    keep = {}
    x = net.inputs(t)
    odds = net.forward(x, words_, live, keep)
    grads, dx = net.backward(x, words_, live, keep, 1 / (1 + np.exp(-odds)) - y)
    for name, g in grads.items():
        w = net.weights[name]
        for i in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            old = w[i]
            w[i] = old + 1e-3
            up = loss()
            w[i] = old - 1e-3
            down = loss()
            w[i] = old
            assert math.isclose((up - down) / 2e-3, float(g[i]), rel_tol=0.05, abs_tol=2e-3), name
    assert dx.shape == x.shape


def test_windows_cover_every_word():
    rows = np.array([0, 0, 1, 33, 65, 200])
    text, first, size = toxicity.windows_of(rows)
    for k in range(5):
        seen = set()
        for f, n in zip(first[text == k], size[text == k], strict=True):
            seen.update(range(f, f + n))
        assert seen == set(range(rows[k], rows[k + 1]))


def test_long_words_are_read_whole():
    run = toxicity.read(pa.array(["awfu"])).grams[1]
    for n in range(30, 160):
        t = toxicity.read(pa.array(["z" * n + "awfu" + "z" * 50, "a b"]))
        assert run in t.grams and t.rows[2] - t.rows[1] == 2
    net = toxicity.Network.new(np.zeros(0, np.uint64), np.random.default_rng(1))
    a, b = (net.scores(toxicity.read(pa.array(["some-" * 300 + last]))) for last in ("awful", "other"))
    assert a != b


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    got = toxicity.query(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    # Labels of this table also fall on a few texts of junk that no score can tell from others.
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.02 * len(clean)


def test_toxicity_edges(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, 60) + (" awful " if k % 4 == 0 else " ") + prose(rng, 50)) for k in range(120)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fitted(docs, labels)
    more = [(1000, None), (1001, ""), (1002, " \n "), (None, "a b"), (1003, "a b"), (1003, "a b"), (1004, "x" * 5000 + " y" * 3000)]
    for make in (documents, clashing):
        got = toxicity.score(make(spark, more), net).collect()
        assert len(got) == len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert len({round(r.score, 9) for r in got if r.doc_id in (1000, 1001, 1002)}) == 1
        assert toxicity.harmless(make(spark, more), net).columns == make(spark, more).columns
    assert toxicity.score(documents(spark, []), net).count() == 0
    none = toxicity.fitted(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def brute(rows):
    own = [(k, [*words(lower(t)), None]) for k, t in rows]
    counts = Counter(x for k, w in own if k is not None and zlib.crc32(str(k).encode()) % 10 for x in w)
    n, v = sum(counts.values()), len(counts)
    return {k: (k is not None and zlib.crc32(str(k).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for k, w in own}


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 5_000)
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randrange(80))) for k in range(150)] + [(900, None), (901, ""), (902, "A a A"), (None, "w1 unseen")]
    want = brute(rows)
    for make in (documents, clashing):
        got = lm.scored(make(spark, rows)).collect()
        assert len(got) == len(rows)
        for r in got:
            held, n, known, train, base = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lm.scored(documents(spark, [])).count() == 0


def test_no_training_text(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = lm.scored(documents(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_contexts_help(spark, monkeypatch):
    """After x always comes y, and elsewhere hardly ever: the tree keeps that context and scores better."""
    rng = random.Random(3)
    rows = [(k, " ".join(w for _ in range(60) for w in (["x", "y"] if rng.random() < 0.5 else [rng.choice("abcdefgh")]))) for k in range(200)]
    monkeypatch.setattr(lm, "least_count", lambda _: 200)
    got = lm.scored(documents(spark, rows)).where("held_out").collect()
    assert got and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def tree_scores(rows, least):
    """The model in plain Python: next-symbol counts of all contexts, the test, smoothing; the score of each text, and the kept contexts' distributions."""
    texts = {k: words(lower(t)) for k, t in rows}
    train = [w for k, w in texts.items() if k is not None and zlib.crc32(str(k).encode()) % 10]
    counts = Counter(x for w in train for x in w)
    types, tokens, ends = len(counts) + 1, sum(counts.values()) + len(train), len(train)
    base = lambda n: (n + 0.1) / (tokens + 0.1 * (types + 1))
    root = {x: base(n) for x, n in counts.items() if n >= least} | {"END": base(ends)}
    root["RARE"] = 1 - sum(root.values())
    coded = lambda w: [None, None, "START", *(x if counts[x] >= least else "RARE" for x in w), "END"]
    context = lambda s, i, d: tuple(s[i - d : i])
    follow = {}
    for w in train:
        s = coded(w)
        for i in range(3, len(s)):
            for d in range(1, lm.DEPTH + 1):
                if not {None, "RARE"} & set(context(s, i, d)):
                    follow.setdefault(context(s, i, d), Counter())[s[i]] += 1
    kept = {}

    def of(c):
        while c and c not in kept:
            c = c[1:]
        return kept[c] if c else root

    for c in sorted(follow, key=len):
        n, parent = follow[c], of(c[1:])
        total = sum(n.values())
        gain = sum(v * math.log(v / total / parent[x]) for x, v in n.items())
        if total >= least and 2 * gain >= len(n) + 4 * math.sqrt(2 * len(n)):
            kept[c] = {x: (n[x] + lm.SMOOTHING * parent[x]) / (total + lm.SMOOTHING) for x in root}
    out = {}
    for k, w in texts.items():
        s = coded(w)
        out[k] = sum(math.log10(of(context(s, i, lm.DEPTH))[s[i]]) for i in range(3, len(s))) + sum(math.log10(base(counts[x]) / root["RARE"]) for x in w if counts[x] < least)
    return out, kept


@pytest.mark.parametrize("least", [8, 40])
def test_scores_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(lm, "least_count", lambda _: least)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 6_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 3_000)
    rng = random.Random(12)
    rows = [(k, " ".join(w for _ in range(rng.randrange(60)) for w in (["In", "x", "y"] if rng.random() < 0.3 else [f"w{int(rng.random() ** 3 * 60)}"]))) for k in range(200)] + [(900, None), (901, ""), (None, "x y unseen x")]
    want, kept = tree_scores(rows, least)
    assert len({len(c) for c in kept}) == (3 if least == 8 else 2) and all(math.isclose(sum(p.values()), 1) for p in kept.values())
    got = {r.doc_id: r.score for r in lm.scored(documents(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_more_text_keeps_more_contexts():
    """What is often is the same count at every size, so the whole text keeps more contexts than a part of it. Of contexts of two symbols either may keep some by chance, which only the divergence test rules on."""
    rng = random.Random(13)
    rows = [(k, " ".join(f"p{j} q{j} z{rng.randrange(9)}" for j in (int(12 * rng.random() ** 2) for _ in range(40)))) for k in range(600)]
    kept = []
    for part in (rows[:60], rows):
        tokens = sum(len(words(t)) + 1 for k, t in part if zlib.crc32(str(k).encode()) % 10)
        kept.append(set(tree_scores(part, lm.least_count(tokens))[1]))
    assert len(kept[0]) < len(kept[1]) and {c for c in kept[0] if len(c) == 1} <= kept[1]
    assert lm.least_count(10**3) == lm.least_count(10**12)


def test_held_out_gain(spark):
    """With its own parameters the tree tells held-out texts' tokens better than their counts alone do."""
    sums = lm.query(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(n_tokens) n", "sum(score) s", "sum(base_score) b").first()
    assert (sums.s - sums.b) / sums.n > 0.15


def test_toxicity_scores_by_hand():
    """Each window cell by cell, in plain Python numbers: gates, both directions, attention, the largest of the windows."""
    rng = random.Random(21)
    texts = [prose(rng, 70), "one TWO, three", prose(rng, 33), ""]
    t = toxicity.read(pa.array(texts))
    net = toxicity.Network.new(np.sort(t.hashes[::2]), np.random.default_rng(5))
    net.bias = -1.5
    w = {k: v.astype(float).tolist() for k, v in net.weights.items()}
    slots, h = net.slots(t.hashes).tolist(), toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    times = lambda x, m: [sum(a * row[j] for a, row in zip(x, m, strict=True)) for j in range(len(m[0]))]

    def vector(word):
        grams = t.grams[t.gram_rows[word] : t.gram_rows[word + 1]].tolist()
        return w["word"][slots[word]] + [sum(w["gram"][g][j] for g in grams) / len(grams) for j in range(toxicity.EMBED)]

    def states(way, xs):
        out, state = [], [0.0] * h
        for x in xs:
            gx, gh = [a + b for a, b in zip(times(x, w[f"x{way}"]), w[f"c{way}"], strict=True)], times(state, w[f"h{way}"])
            z, r = [sigmoid(gx[j] + gh[j]) for j in range(h)], [sigmoid(gx[h + j] + gh[h + j]) for j in range(h)]
            n = [math.tanh(gx[2 * h + j] + r[j] * gh[2 * h + j]) for j in range(h)]
            state = [n[j] + z[j] * (state[j] - n[j]) for j in range(h)]
            out.append(state)
        return out

    def odds(words_):
        xs = [vector(k) for k in words_]
        both = [f + b for f, b in zip(states("f", xs), states("b", xs[::-1])[::-1], strict=True)]
        s = [sum(math.tanh(a) * v for a, v in zip(times(x, w["a"]), w["v"], strict=True)) for x in both]
        e = [math.exp(a - max(s)) for a in s]
        pooled = [sum(a / sum(e) * x[j] for a, x in zip(e, both, strict=True)) for j in range(2 * h)]
        return sum(a * b for a, b in zip(pooled, w["o"], strict=True)) + w["ob"][0]

    got = net.scores(t)
    for k in range(3):
        lo, hi = int(t.rows[k]), int(t.rows[k + 1])
        starts = range(lo, max(lo, hi - toxicity.WINDOW + toxicity.STRIDE - 1) + 1, toxicity.STRIDE)
        want = max(sigmoid(odds(t.word[s : min(hi, s + toxicity.WINDOW)].tolist())) for s in starts)
        assert math.isclose(got[k], want, rel_tol=1e-4), k
    assert math.isclose(got[3], sigmoid(-1.5), rel_tol=1e-6)


def test_packed_numbers_and_keys():
    """Numbers come back from as few bytes each as hold them; pairs' keys ascend within their bucket, and equal hashes meet in one bucket whatever the block."""
    rng = np.random.default_rng(4)
    for top in (0, 1, 255, 256, 1 << 24, (1 << 62) + 5):
        n = np.append(rng.integers(0, top + 1, 9), top)
        assert (lm._unpacked(lm._packed(n), 10) == n).all() and len(lm._packed(n)) == 10 * max(1, (top.bit_length() + 7) // 8)
    assert len(lm._unpacked(lm._packed(n[:0]), 0)) == 0
    hashes = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
    for kind in (lm.WORDS, lm.PAIRS, lm.CONTEXTS):
        whole = {h: b for b, at, _ in lm._split(kind, hashes, 7) for h in hashes[at].tolist()}
        assert len(whole) == 500 and set(whole.values()) == set(range(7))
        for b, at, keys in lm._split(kind, hashes[:100], 7):
            assert all(whole[h] == b for h in hashes[at].tolist())
            if kind == lm.PAIRS:
                assert (np.cumsum(lm._unpacked(keys, len(at))).view(np.uint64) == hashes[at] >> np.uint64(64 - lm.KEY_BITS)).all()


def test_pairs_travel_in_few_bytes(spark, monkeypatch):
    """A pair takes some bytes less than its hash did, and no answer is shuffled a second time."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 60, 200))) for k in range(30)]
    sent, answered = {}, lm._answered

    def seen(asked, *more):
        for r in asked.where("depth > 0").collect():
            sent[r.depth, r.kind] = sent.get((r.depth, r.kind), 0) + sum(len(x) for x in r if isinstance(x, (bytes, bytearray)))
        return answered(asked, *more)

    monkeypatch.setattr(lm, "_answered", seen)
    scores = lm.scored(documents(spark, rows))
    pairs = {p for _, t in rows for p in zip(["start", *t.split()], [*t.split(), "end"], strict=True)}
    assert 0 < sent[1, lm.PAIRS] < 3 * len(pairs)
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()


def test_contexts_in_several_buckets(spark, monkeypatch):
    """Contexts of many places are dealt to several buckets by their next symbol, with the same scores."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(["the", *(f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 40)) ** 2 // 8)])) for k in range(90)]
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 400)
    plain, split = [], []
    for places, out in ((lm.SPLIT, plain), (25, split)):
        monkeypatch.setattr(lm, "SPLIT", places)
        out += sorted(map(tuple, lm.scored(documents(spark, rows)).collect()))
    assert len(plain) == 90 and all(a[:-1] == b[:-1] and math.isclose(a[-1], b[-1], rel_tol=1e-12) for a, b in zip(plain, split, strict=True))
    want, _ = tree_scores(rows, lm.LEAST)
    assert all(math.isclose(r[-1], want[r[0]], rel_tol=1e-9) for r in split)


def test_bundles():
    rng = np.random.default_rng(5)
    for arrays in ([np.zeros(0, np.int64)], [rng.integers(0, 1 << k, k) for k in range(1, 63)], [np.diff(np.sort(rng.integers(0, 1 << 63, 9).astype(np.uint64) * np.uint64(2)), prepend=np.uint64(0)), np.arange(3)]):
        back = lm._unbundled(lm._bundled(*arrays))
        assert all((x.astype(np.uint64) == y.astype(np.uint64)).all() and len(x) == len(y) for x, y in zip(arrays, back, strict=True))
