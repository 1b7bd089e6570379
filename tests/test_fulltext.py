"""Match expressions against a scan in plain Python."""

import random
import re

import pytest

from rasterloom.operators import fulltext


def tokens(text):
    out = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in out]


def at(ws, phrase, prefix=False):
    n = len(phrase)
    fits = lambda i: ws[i : i + n - 1] == phrase[:-1] and i + n <= len(ws) and (ws[i + n - 1].startswith(phrase[-1]) if prefix else ws[i + n - 1] == phrase[-1])
    return [i for i in range(len(ws)) if fits(i)]


def near(ws, a, b, n):
    first, second = at(ws, a), at(ws, b)
    return any(0 <= q - p - len(a) <= n or 0 <= p - q - len(b) <= n for p in first for q in second)


CASES = {
    "a b": lambda w: at(w, ["a"]) and at(w, ["b"]),
    "A AND b": lambda w: at(w, ["a"]) and at(w, ["b"]),
    "a OR b c": lambda w: at(w, ["a"]) or at(w, ["b"]) and at(w, ["c"]),
    "a NOT b OR c": lambda w: at(w, ["a"]) and not at(w, ["b"]) or at(w, ["c"]),
    "(a OR b) NOT (c OR d)": lambda w: (at(w, ["a"]) or at(w, ["b"])) and not (at(w, ["c"]) or at(w, ["d"])),
    '"a b c"': lambda w: at(w, ["a", "b", "c"]),
    '"a a"': lambda w: at(w, ["a", "a"]),
    '"b xy*"': lambda w: at(w, ["b", "xy"], True),
    "xy*": lambda w: at(w, ["xy"], True),
    "a-b": lambda w: at(w, ["a", "b"]),
    "a NEAR/1 b": lambda w: near(w, ["a"], ["b"], 1),
    "a NEAR/0 \"b c\"": lambda w: near(w, ["a"], ["b", "c"], 0),
    "a NEAR/2 b NEAR/1 d": lambda w: near(w, ["a"], ["b"], 2) and near(w, ["b"], ["d"], 1),
    "a NEAR xyz NOT d": lambda w: near(w, ["a"], ["xyz"], 10) and not at(w, ["d"]),
    "NEARBY OR ORB": lambda w: at(w, ["nearby"]) or at(w, ["orb"]),
    "é": lambda w: at(w, ["é"]),
    "nowhere": lambda w: False,
}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = ["a", "b", "c", "d", "A", "xyz", "XYab", "é", "nearby", "orb", "q1"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "-"]) for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["", None, "...", "a b" * 3, "a " * 20000 + "b"]
    rows = [(k, t, "x", [1]) for k, t in enumerate(texts)]
    return rows, fulltext.indexed(spark.createDataFrame([*rows, (None, "a b c", "y", [2])], "id long, text string, term string, places array<int>"), "id", "text")


@pytest.mark.parametrize("expression", CASES)
def test_against_a_scan(corpus, expression):
    rows, index = corpus
    got = [r.key for r in fulltext.matching(index, expression).collect()]
    assert sorted(got) == [k for k, t, *_ in rows if CASES[expression](tokens(t))]


def test_errors_and_empty_tables(spark, corpus):
    _, index = corpus
    for bad in ("", "a OR", "(a", "a )", "NOT a", '""', "a NEAR (b)", "...", "AND"):
        with pytest.raises(fulltext.MatchError):
            fulltext.matching(index, bad)
    empty = fulltext.indexed(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert fulltext.matching(empty, "a OR b*").count() == 0


def test_a_frequent_term_is_spread(spark):
    docs = spark.range(4000).selectExpr("id", "concat('same ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = fulltext.indexed(docs, "id", "text")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = index.where("term = 'same'").selectExpr("input_file_name() AS f").groupBy("f").count().collect()
    assert sum(r["count"] for r in files) == 4000 and len(files) > 1
    plan = index.where("term = 'same'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,same)]" in plan
