"""Edge cases of the expression helpers (JVM split, IEEE division, JVM
number parsing, quoted CSV split, verdicts)."""

import math

from pyspark.sql import functions as F

from clusterlens.functions.numeric import ieee_div, java_double, java_int, pearson
from clusterlens.functions.strings import quoted_csv_split, short_host
from clusterlens.functions.text import WORD_DELIMITERS, java_split, split_lines
from clusterlens.operators.stats import verdict, VERDICT_NONE, VERDICT_POSITIVE, VERDICT_NEGATIVE, VERDICT_WEAK


def _one(spark, expr, rows, schema="s string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_java_split_word_delimiters(spark):
    rows = [("",), ("...",), ("a.b",), (".a",), ("a..",), ("Hi, there!  (yes)",), ("tab\there",)]
    got = _one(spark, java_split(F.col("s"), WORD_DELIMITERS), rows)
    assert got == [[""], [], ["a", "b"], ["", "a"], ["a"], ["Hi,", "there!", "yes"], ["tab\there"]]


def test_java_split_single_space_drops_all_trailing(spark):
    got = _one(spark, java_split(F.col("s"), " "), [("a  ",), ("  a b",), ("   ",), ("a  b",)])
    assert got == [["a"], ["", "", "a", "b"], [], ["a", "", "b"]]


def test_split_lines(spark):
    rows = [("a\nb\n",), ("a\r\nb",), ("a\rb\r\n",), ("",), ("\n",), ("x\n\n",)]
    got = _one(spark, split_lines(F.col("s")), rows)
    assert got == [["a", "b"], ["a", "b"], ["a", "b"], [], [""], ["x", ""]]


def test_ieee_div(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 0.0), (6.0, 3.0), (None, 1.0)]
    got = _one(spark, ieee_div(F.col("a"), F.col("b")), rows, "a double, b double")
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and math.isnan(got[3])
    assert got[4] == 2.0 and got[5] is None


def test_pearson_constant_column_is_nan(spark):
    df = spark.createDataFrame([(3.0, 6.0, 12.0, 18.0, 3.0, 48.0)], "n double, sx double, sy double, sxy double, sxx double, syy double")
    r = df.select(pearson(*[F.col(c) for c in df.columns])).first()[0]
    assert math.isnan(r)


def test_java_int(spark):
    rows = [("5",), ("+5",), ("-12",), (" 5",), ("5 ",), ("5.7",), ("2147483648",), ("",), ("x",)]
    assert _one(spark, java_int(F.col("s")), rows) == [5, 5, -12, 0, 0, 0, 0, 0, 0]


def test_java_double(spark):
    rows = [("1.5",), (" 2 ",), ("1e3",), ("1.0d",), ("0x1p3",), ("NaN",), ("-NaN",), ("nan",), ("inf",),
            ("Infinity",), ("-Infinity",), ("INFINITY",), ("1e999",), ("abc",), ("",)]
    got = _one(spark, java_double(F.col("s")), rows)
    assert got[:5] == [1.5, 2.0, 1000.0, 1.0, 8.0]
    assert math.isnan(got[5]) and math.isnan(got[6])
    assert got[7] == 0.0 and got[8] == 0.0
    assert got[9] == math.inf and got[10] == -math.inf and got[11] == 0.0 and got[12] == math.inf
    assert got[13] == 0.0 and got[14] == 0.0


def test_quoted_csv_split_matches_lookahead_rule(spark):
    cases = ['a,b,"c,d",e', '"x', 'a,"b', '"a,b",,"",c', '', ',', 'a""b,c', '"a"b"c,d', 'a,b,"c', '""",,"',
             '1,"Artist, 7",,x']
    ref = F.transform(F.split("s", ',(?=([^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.regexp_replace(x, '"', ''))
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    for r in df.select(ref.alias("ref"), quoted_csv_split(F.col("s")).alias("new")).collect():
        assert r.ref == r.new


def test_short_host(spark):
    assert _one(spark, short_host(F.col("s")), [("n1.cluster.local",), ("n2",), ("10.0.0.1",)]) == ["n1", "n2", "10"]


def test_verdict_nan_first(spark):
    rows = [(float("nan"),), (0.7,), (-0.5,), (0.2,), (-0.1,), (0.05,), (None,)]
    got = _one(spark, verdict(F.col("r")), rows, "r double")
    assert got == [VERDICT_NONE, VERDICT_POSITIVE, VERDICT_NEGATIVE, VERDICT_WEAK, VERDICT_WEAK, VERDICT_NONE,
                   VERDICT_NONE]


def test_java_split_rtrim_form_equals_regex_form(spark):
    rows = [("",), ("...",), ("a.b",), (".a",), ("a..",), ('a " ',), ("x?)",), ("  a  b  ",), ("a;b:c(d)e?f\"g",)]
    a = _one(spark, java_split(F.col("s"), WORD_DELIMITERS), rows)
    b = _one(spark, java_split(F.col("s"), WORD_DELIMITERS, ' .;:()?"'), rows)
    c = _one(spark, java_split(F.col("s"), " "), rows)
    d = _one(spark, java_split(F.col("s"), " ", " "), rows)
    assert a == b and c == d


def test_number_parsers_are_one_pattern_each(spark):
    from clusterlens.functions.numeric import java_double, java_int

    assert str(java_double(F.col("s"))).upper().count("RLIKE") == 1 and "BTRIM" not in str(java_double(F.col("s"))).upper()
    inf, odd = float("inf"), [("nan", 0.0), (" -inf", 0.0), ("INFINITY\t", 0.0), ("+Infinity", float("inf")), ("1e999", float("inf")),
                              ("-1e999", -float("inf")), ("1.5 ", 1.5), ("x", 0.0), (None, 0.0), ("-Infinity\n", -float("inf"))]
    df = spark.createDataFrame(odd, "s string, want double")
    assert df.where(~java_double(F.col("s")).eqNullSafe(F.col("want"))).count() == 0
    nan = spark.createDataFrame([("NaN",), (" -NaN ",)], "s string").select(java_double(F.col("s")).alias("d"))
    assert all(r.d != r.d and r.d != inf for r in nan.collect())
    ints = [("7", 7), ("+7", 7), ("-0", 0), ("007", 7), (" 7", 0), ("7 ", 0), ("2147483648", 0), ("-2147483648", -2147483648), ("", 0), (None, 0)]
    df = spark.createDataFrame(ints, "s string, want int")
    assert df.where(~java_int(F.col("s")).eqNullSafe(F.col("want"))).count() == 0
