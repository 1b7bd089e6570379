"""Quality rules against plain Python: counts, exact binomial tails, cutoffs and verdicts."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import quality_rules as q
from tests.llm.helpers import clashing, documents, prose, varied, words


def counts(text):
    ws = words(text)
    places = {}
    for i in range(len(ws) - 7):
        places.setdefault(tuple(ws[i : i + 8]), []).append(i)
    repeated = {p for own in places.values() if len(own) > 1 for i in own for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), len(lines)


def base_failed(c):
    return c[0] < 20 or 100 * c[4] > 30 * c[0]


def rates(c):
    n, chars, symbols, dup, repeated, lines = c
    return {"symbols": symbols * 1000 // max(n, 1), "dup_lines": dup * 1000 // max(lines, 1), "repeats": repeated * 1000 // max(n, 1), "word_chars": chars * 1000 // max(n, 1)}


def odd_texts():
    rng = random.Random(4)
    out = [t for _, t in varied(rng)]
    out += ["a b c d e f g h " * 2, "a b c d e f g h", "a " * 9, "x y " * 30 + prose(rng, 50), "l1 a\nl1 a\n\n\n \nl2\nl2\nl2", "#*$%&|<>" * 5 + " \U0001f600é", "a\x0bb\x0cc\rd　e\x85f", "w\n" * 40, "ab c " * 40000]
    return out


def test_counts(spark):
    rows = list(enumerate(odd_texts())) + [(None, "null key"), (0, "again")]
    for make in (documents, clashing):
        df = make(spark, rows)
        got = q.measured(df, "lang" if "lang" in df.columns else "key").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "symbols", "dup_lines", "repeats", "word_chars_mean").collect()
        want = [(k, *counts(t), base_failed(counts(t)), *rates(counts(t)).values()) for k, t in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert q.measured(documents(spark, [])).count() == 0


def tail(k, n, p):
    p = Fraction(p).limit_denominator(10**6)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("p", [0.005, 0.3])
def test_binomial_tail(spark, p):
    cases = [(k, n) for n in (0, 1, 2, 10, 20, 21, 50, 700, 3000) for k in (0, 1, 2, 3, 5, 12, 80, 700) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", q.binomial_tail(F.col("k"), F.col("n"), p))
    for r in df.collect():
        want = tail(r.k, r.n, p)
        if r.k >= r.n * p:
            assert r.p == 1 and want > 0.25
        else:
            assert want * (1 - 1e-9) <= r.p <= want * (1 + 1e-9) + 1e-300
    # Far beyond where the terms could be summed one by one.
    far = spark.createDataFrame([(49_000_000, 10_000_000_000)], "k long, n long").select(q.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).first().p
    assert 0 < far < 1e-300 or far == 0.0


def plain_cutoffs(good, alpha, delta):
    """By exact sums of fractions: loosest cutoff first, until a test fails. good: (stratum, rates)."""
    strata = {s for s, _ in good}
    out = {}
    for s in strata:
        own = [r for x, r in good if x == s]
        for rule, (top, step, last) in q.GRIDS.items():
            cut = None
            for c in range(top, last - 1, -step):
                k = sum(r[rule] > c for r in own)
                if k >= len(own) * alpha / 4 or tail(k, len(own), alpha / 4) > delta / (4 * len(strata)):
                    break
                cut = c
            out[s, rule] = cut
    return out


def corpus(seed, n=900):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        bad = rng.random() < 0.15
        text = prose(rng, rng.randrange(15, 60))
        if bad:
            text = rng.choice([text.replace(" ", "*** "), "same line here now\n" * 12 + text, text.upper().replace(" ", "!!!!!! "), ""])
        elif rng.random() < 0.02:
            text += " #"
        rows.append((k, text, lang, "s", 0))
        if rng.random() < 0.8:
            labels.append((k, int(not bad)))
    labels += [(labels[0][0], 0), (None, 1), (rows[1][0], None), (10**9, 1)]
    return rows, labels


def test_cutoffs_and_verdicts(spark):
    rows, labels = corpus(5)
    rows += [rows[3], rows[3], (None, rows[5][1], "en", "s", 0)]
    alpha, delta = 0.2, 0.1
    quality = {}
    for k, v in labels:
        if k is not None and v is not None:
            quality[k] = min(v, quality.get(k, 1))
    all_rates = [(k, lang or "", counts(t)) for k, t, lang, _, _ in rows]
    good = [(s, rates(c)) for k, s, c in all_rates if quality.get(k) == 1 and not base_failed(c)]
    cut = plain_cutoffs(good, alpha, delta)
    assert any(c is not None for c in cut.values()) and any(s == "" for s, _ in cut)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = q.judged(docs, marks, alpha=alpha, delta=delta)
    want = []
    for k, s, c in all_rates:
        beyond = [r for r, v in rates(c).items() if cut.get((s, r)) is not None and v > cut[s, r]]
        reason = "base" if base_failed(c) else beyond[0] if beyond else None
        want.append((k, reason, reason is None))
    result = sorted(((r.doc_id, r.reason, r.kept) for r in got.collect()), key=str)
    assert result == sorted(want, key=str)
    assert {r for _, r, _ in result} >= {"base", "symbols"}


def test_false_rejection_stays_bounded(spark):
    """Cutoffs from one half of the good documents reject few of the other half; where labels suffice for a cutoff (en), most of the bad ones go."""
    rows, labels = corpus(6, 4000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    alpha = 0.08
    got = {r.doc_id: r for r in q.judged(docs, marks.where("doc_id % 2 = 0"), alpha=alpha).collect()}
    fresh = [k for k, v in labels if k in got and k % 2 == 1 and v == 1 and not got[k].base_failed]
    lost = sum(not got[k].kept for k in fresh)
    assert lost <= alpha * len(fresh)
    bad = [k for k, v in labels if k in got and v == 0 and not got[k].base_failed and rows[k][2] == "en"]
    assert sum(not got[k].kept for k in bad) > 0.7 * len(bad)


def test_without_labels_and_many_strata(spark, monkeypatch):
    rows, labels = corpus(7, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    none = q.judged(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.reason for r in none.collect()} == {"base", None}
    monkeypatch.setattr(q, "BROADCAST_STRATA", 0)
    assert q.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).count() == len(rows)
    assert q.judged(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_main_path_is_native(spark):
    rows, labels = corpus(8, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = q.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
