"""Quality rules with risk-controlled thresholds, in JVM functions only.

Every document is measured; some rules are fixed (base), the others reject what lies beyond a cutoff. A
cutoff is chosen for each stratum (language) from labelled documents: the strictest one of a fixed, descending
grid whose false rejection of good documents is shown, by an exact binomial tail, to stay under the rule's
share of the allowed risk. A grid is tested from its loosest cutoff on until a test fails, which needs no
correction within the grid; strata and rules share the error by Bonferroni's correction. So with probability
1 - DELTA no stratum loses more than ALPHA of its good documents to these rules, as far as labels say what is
good and labelled documents are drawn like the others. A stratum with too few labels keeps all that pass base.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import word_text, written

#: Share of a stratum's good documents that the rules together may reject, and the probability that this fails anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Words of a window whose recurrence counts, runs of characters that are no symbols, words that base asks for, percent of repeated words that it allows.
WINDOW, NO_SYMBOLS, LEAST_WORDS, MOST_REPEATED = 8, "[^#*$%&|<>]+", 20, 30
#: Rule: loosest cutoff, step and strictest cutoff of its grid, all in thousandths.
GRIDS = {"symbols": (1000, 10, 0), "dup_lines": (1000, 10, 0), "repeats": (1000, 10, 0), "word_chars": (12000, 50, 3000)}
#: Strata up to whose number the table of cutoffs may be broadcast; a larger one is joined by shuffling.
BROADCAST_STRATA = 10_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out once for the row; a column named inside a lambda would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column, size: int) -> Column:
    """Words covered by windows of `size` words that are found twice or more among the array's own."""
    at = lambda a, i: F.get(a, i)
    n = F.size(words) - (size - 1)
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(at(w, i + j) for j in range(size))))

    def covered(w: Column, h: Column) -> Column:
        def same(s: Column, a: Column, b: Column) -> Column:
            out = at(s, a)["h"] == at(s, b)["h"]
            for j in range(size):
                out = out & (at(w, at(s, a)["i"] + j) == at(w, at(s, b)["i"] + j))
            return F.coalesce(out, F.lit(False))

        def places(s: Column) -> Column:
            as_before = F.transform(s, lambda x, k: (k > 0) & same(s, k, k - 1))
            twice = lambda f: F.transform(s, lambda x, k: F.when(at(f, k) | F.coalesce(at(f, k + 1), F.lit(False)), x["i"]))
            return _let(as_before, lambda f: F.sort_array(F.filter(twice(f), lambda i: i.isNotNull())))

        def add(a: Column, i: Column) -> Column:
            return F.struct((a["n"] + i + size - F.greatest(i, a["end"])).alias("n"), (i + size).alias("end"))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: F.aggregate(places(s), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda a: a["n"]))

    counted = _let(words, lambda w: _let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(w, h))))
    return F.when(n < 2, F.lit(0)).otherwise(counted).cast("long")


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed and each rule's value in thousandths, a row for each row of docs.

    n_lines counts lines with a word. Null and empty texts have no words and fail base; a null stratum is "".
    Rows of a null or repeated doc_id are measured one by one. Texts of any length are read whole; their words,
    and a hash for each window, must fit in a task. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    own = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    # Evaluated once a row: nothing below names the words but through _let or as a whole.
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = own.select(
        "doc_id",
        "stratum",
        F.length(F.regexp_replace("text", NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _let(word_text(), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated_words(w, WINDOW).alias("repeated"))).alias("words"),
    )
    out = found.select("doc_id", "stratum", F.col("words.n").alias("n_words"), F.col("words.chars").alias("word_chars"), "n_symbols", F.col("lines.dup").alias("n_dup_lines"), F.col("words.repeated").alias("n_repeat_words"), F.col("lines.n").alias("n_lines"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(F.lit(0)).cast("long")
    return out.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words").alias("symbols"),
        rate("n_dup_lines", "n_lines").alias("dup_lines"),
        rate("n_repeat_words", "n_words").alias("repeats"),
        rate("word_chars", "n_words").alias("word_chars_mean"),
    )


def _value(rule: str) -> str:
    return "word_chars_mean" if rule == "word_chars" else rule


def _log_factorial(n: Column) -> Column:
    """ln n!: by the product up to 20, by Stirling's series beyond, whose next term is under 1e-12 there."""
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """The probability of k or fewer among n at rate p; 1 from k >= n p on, where no test can succeed.

    The terms are summed from the largest down, 200 + 40 sqrt(k) of them; below, each is at most a fixed part of the
    one above, and what a geometric series of that ratio comes to is added. So the result is never too small.
    """
    log_term = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.floor(200 + 40 * F.sqrt(k)).cast("long"))
    ratio = lambda m: (k - m).cast("double") * (1 - p) / ((n - k + m + 1).cast("double") * p)

    def add(a: Column, m: Column) -> Column:
        term = a["term"] * ratio(m - 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    first = F.struct(F.exp(log_term).alias("term"), F.exp(log_term).alias("sum"))
    summed = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")), first, add, lambda a: a["sum"] + F.when(ratio(steps) > 0, a["term"] * ratio(steps) / (1 - ratio(steps))).otherwise(F.lit(0.0)))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), summed))


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and cut_<rule> for each rule, null where no cutoff could be shown safe. good: measured rows of good documents that pass base.

    Strata without a good document have no row. An empty table gives no rows.
    """
    rules = list(GRIDS)
    share = alpha / len(rules)
    # The place in its grid of the first cutoff that rejects a row.
    place = {r: F.greatest(F.lit(0), F.least(F.lit((top - last) // step + 1), F.floor((F.lit(top) - F.col(_value(r))) / step) + 1)).cast("int") for r, (top, step, last) in GRIDS.items()}
    each = good.select("stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), place[r].alias("place")) for r in rules))).alias("e")).select("stratum", "e.rule", "e.place")
    counts = written(each.groupBy("stratum", "rule", "place").count())
    strata = counts.select("stratum").distinct().count()
    grid = counts.select("stratum", "rule").distinct().withColumn("place", F.explode(_by_rule(lambda r: F.sequence(F.lit(0), F.lit((GRIDS[r][0] - GRIDS[r][2]) // GRIDS[r][1])))))
    at = grid.join(counts, ["stratum", "rule", "place"], "left").unionByName(counts.join(grid, ["stratum", "rule", "place"], "left_anti"))
    own = "PARTITION BY stratum, rule"
    at = at.withColumns({"k": F.expr(f"sum(coalesce(count, 0L)) OVER ({own} ORDER BY place)"), "n": F.expr(f"sum(coalesce(count, 0L)) OVER ({own})")})
    tested = at.select("stratum", "rule", "place", (binomial_tail(F.col("k"), F.col("n"), share) <= delta / max(1, strata * len(rules))).alias("safe"))
    tested = tested.withColumn("safe", F.expr(f"every(safe) OVER ({own} ORDER BY place)")).where("safe")
    chosen = tested.groupBy("stratum", "rule").agg(F.max("place").alias("place")).withColumn("cut", _by_rule(lambda r: (F.lit(GRIDS[r][0]) - GRIDS[r][1] * F.col("place")).cast("long")))
    wide = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in rules))
    return counts.select("stratum").distinct().join(wide, "stratum", "left")


def _by_rule(value: Callable[[str], Column]) -> Column:
    out = F.lit(None)
    for r in GRIDS:
        out = F.when(F.col("rule") == r, value(r)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """What measured() returns, with kept and reason ("base", a rule, or null): false if base fails or a value lies beyond its stratum's cutoff.

    labels: doc_id and quality; 1 is good. Of several labels of a doc_id the smallest counts; null doc_ids and
    null qualities label nothing, and every row of a labelled doc_id counts. Without labels only base rejects.
    """
    rows = written(measured(docs, stratum))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    table = written(cutoffs(rows.where("NOT base_failed").join(good, "doc_id", "left_semi"), alpha, delta))
    if table.count() <= BROADCAST_STRATA:
        table = F.broadcast(table)
    reason = F.when(F.col("base_failed"), "base")
    for r in GRIDS:
        reason = reason.when(F.col(_value(r)) > F.col(f"cut_{r}"), r)
    return rows.join(table, "stratum", "left").withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 8)) AS v(p) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM t, unnest(string_split(text, chr(10))) AS s(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(line.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(line.n, 0) AS n_lines
      FROM t JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols * 1000 // greatest(n_words, 1) AS f1, n_dup_lines * 1000 // greatest(n_lines, 1) AS f2,
        n_repeat_words * 1000 // greatest(n_words, 1) AS f3, word_chars * 1000 // greatest(n_words, 1) AS f4 FROM m),
good AS (SELECT stratum, f1, f2, f3, f4 FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
g(rule, cut) AS (SELECT r, c FROM (VALUES (1), (2), (3)) AS a(r), range(0, 1001, 10) AS x(c) UNION ALL SELECT 4, c FROM range(3000, 12001, 50) AS x(c)),
k AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER ([f1, f2, f3, f4][rule] > cut) AS k FROM good, g GROUP BY ALL),
p AS (SELECT stratum, rule, cut, CASE WHEN k >= n * 0.005 THEN 1.0 ELSE
        (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.005) + (n - i) * ln(0.995))) FROM unnest(range(0, k + 1)) AS q(i)) END AS tail FROM k),
safe AS (SELECT stratum, rule, cut FROM (SELECT *, bool_and(tail <= 0.05 / (4 * (SELECT count(DISTINCT stratum) FROM good))) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS ok FROM p) WHERE ok),
c AS (SELECT stratum, min(cut) FILTER (rule = 1) AS c1, min(cut) FILTER (rule = 2) AS c2, min(cut) FILTER (rule = 3) AS c3, min(cut) FILTER (rule = 4) AS c4 FROM safe GROUP BY stratum),
r AS (SELECT b.*, CASE WHEN base_failed THEN 'base' WHEN f1 > c1 THEN 'symbols' WHEN f2 > c2 THEN 'dup_lines' WHEN f3 > c3 THEN 'repeats' WHEN f4 > c4 THEN 'word_chars' END AS reason FROM b LEFT JOIN c USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM r
"""
