"""Fixtures and plain-Python versions that the operators' tests share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those the operators use inside.
CLASHING = "doc_id long, text string, block long, bucket long, key string, a long, b long, score double, bands string, line long, tokens string, n_words long, kept string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "src0", None if t is None else len(t)) for k, t in rows], SCHEMA)


def clashing(spark, rows):
    return spark.createDataFrame([(k, t, 1, 2, "k", 3, 4, 0.5, "b", 5, "t", 6, "x") for k, t in rows], CLASHING)


def prose(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def varied(rng):
    """Texts with copies, near copies, shared passages, blanks, nulls, periods and one very long text."""
    base = [prose(rng, n) for n in (3, 40, 80, 200, 400)]
    shared = prose(rng, 60)
    out = [*base, *base[2:4], base[3].replace("w1", "v1"), f"{prose(rng, 30)} {shared} {prose(rng, 20)}", f"{shared}\n{prose(rng, 5)}", "", None, "   \n\t ", "a, " * 300, "b " * 36, "éß \U0001f600 " * 30, prose(rng, 20000, 50)]
    return list(enumerate(out))
