import pytest
from pyspark.sql import functions as F

from rasterloom.functions.expressions import ExpressionError, compiled, split_list
from rasterloom.functions.parameters import FUNCTIONS, arithmetic, resolved, step_index, table_value


@pytest.mark.parametrize(
    ("text", "value"),
    [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ^ 3 ^ 2", 512), ("-2 ^ 2", -4), ("1 < 2 && 3 >= 3", 1), ("1 == 2 || 0", 0), ("1 ? 2 : 3", 2), ("0 ? 1 : 0 ? 2 : 3", 3), ("7 / 0", None), ("sqrt(-1)", None), ("log10(0)", None),
     ("min(3, 1, 2) + max(3, 1, 2)", 4), ("sum(1, 2, 3) / avg(1, 3)", 3), ("rint(2.5)", 2), ("fmod(-7, 3)", -1), ("1e3 + .5", 1000.5), ("x + a", 5)],
)
def test_value(spark, text, value):
    df = spark.createDataFrame([(2.0, 3.0)], "x double, a double")
    assert df.select(compiled(text, {"x": F.col("x"), "a": F.col("a")})).first()[0] == value


@pytest.mark.parametrize("text", ["1 +", "(1", "foo(1)", "unknown", "1 $ 2", "1 2"])
def test_errors(text, spark):
    with pytest.raises(ExpressionError):
        compiled(text, {})


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    for text in ("x + 1", "x > 1", "x ? 1 : 2", "-x"):
        assert df.select(compiled(text, {"x": F.col("x")})).first()[0] is None


def test_lists():
    assert split_list("a + 1, max(a, b), c") == ["a + 1", "max(a, b)", "c"]


@pytest.mark.parametrize(("text", "value"), [("1 + 2", "3"), ("2 ^ 0.5", "1.4142135623731"), ("3 > 2 ? 10 : 20", "10"), ("0 ? 1 : 0 ? 2 : 3", "3"), ("max(1, 5) % 3", "2"), ("1 && 0", "0")])
def test_arithmetic(text, value):
    assert arithmetic(text)[:14] == value[:14]


def test_arithmetic_refuses_other_code():
    for text in ("__import__('os')", "(1).real", "x", "[1]"):
        with pytest.raises((ValueError, SyntaxError)):
            arithmetic(text)


def test_parameters(spark):
    t = spark.createDataFrame([(0, "a"), (1, "b")], "id long, v string")
    assert resolved("$[t:v:1]$-$[t:v:$[math:1+1]$]$", tables={"t": t}) == "a-b"
    assert resolved("$[t:rowcount]$x$[t:columncount]$", tables={"t": t}) == "2x2"
    assert resolved("$[setting:a]$$[setting:none]$", {"a": "1"}) == "1"
    assert resolved("$[func:hasAttribute(t,v)]$", tables={"t": t}) == "1"
    assert resolved("$[it]$/$[it:files:idx-1]$", steps={"it": 3}, properties={"it": {"files": ["p", "q", "r"]}}) == "3/q"


def test_functions():
    f = FUNCTIONS
    assert f["strListItem"]("a,,b", ",", "9") == "b" and f["strListItem"]("a,,b", ",") == "a" and f["strListLength"]("a,,b", ",") == "2"
    assert f["cond"]("0", "a", "b") == "b" and f["cond"]("yes", "a", "b") == "a" and f["cond"]("1 - 1", "a", "b") == "b"
    assert f["fileBaseName"]("/x/a.b.c") == "a" and f["fileCompleteSuffix"]("/x/a.b.c") == "b.c" and f["filePath"]("a") == "."
    assert f["strCompare"]("A", "a") == "0" and f["strCompare"]("A", "a", "1") == "-1" and f["strContains"]("xAy", "a") == "1"
    assert [step_index("cycle", s, 2) for s in (1, 2, 3)] == [0, 1, 0] and step_index("use_up", 9, 3) == 2 and step_index("sync", 9, 3, 2) == 1


def test_null_in_min_and_max(spark):
    df = spark.createDataFrame([(None, 3.0), (2.0, 3.0)], "a double, b double")
    names = {"a": F.col("a"), "b": F.col("b")}
    for text, want in {"min(a, b)": [None, 2.0], "min(b, a)": [None, 2.0], "max(a, b, 1)": [None, 3.0], "max(1, b, a)": [None, 3.0], "min(b)": [3.0, 3.0]}.items():
        assert [r[0] for r in df.select(compiled(text, names)).collect()] == want, text


@pytest.mark.parametrize("text, want", [("(int)7.9 + (int)(0 - 7.9)", 0.0), ("(float)3 / 2", 1.5), ("3!", 6.0), ("2 + 3! * 2", 14.0), ("!0 + !5", 1.0), ("6 & 3 | 8", 10.0), ("1 << 4 >> 2", 4.0), ("1 == 1 and 0 or 1", 1.0), ("2k + 3m", 2000.003), ("5µ * 1M", 5.0), ("strlen(concat('ab', toupper('cd')))", 4.0), ("str2dbl('1e3')", 1000.0), ("str2dbl('x')", None), ("sizeof(1, 2, 3)", 3.0)])
def test_casts_bits_text_and_units(spark, text, want):
    got = spark.range(1).select(compiled(text, {})).first()[0]
    assert got == want or abs(got - want) < 1e-9


def test_table_value_by_row_number(spark):
    df = spark.createDataFrame([(4, "c"), (0, "a"), (2, "b")], "id int, name string")
    assert [table_value(df, "name", str(k)) for k in (1, 2, 3, 4, 0)] == ["a", "b", "c", "", ""]
    assert table_value(df, "rowcount", "") == "3"
