"""Values of literal expressions, many to a job; errors; diagnostics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry.engine import Engine
from cohortry.errors import EvaluationFault, LogicError, SemanticFault, SyntaxFault, TooCostlyFault
from cohortry.functions import values as V
from cohortry.plans.lower import Scope
from cohortry.plans.syntax import parse_expression, parse_library
from cohortry.plans.types import ANY

#: expression -> an expression it is equal to, nulls included
CASES = {
    "logic": {"true and null": "null", "false and null": "false", "true or null": "true", "false implies null": "true", "null implies false": "null", "true xor null": "null", "not null": "null"},
    "numbers": {"7 div -2": "-3", "-7 mod 3": "-1", "1 / 0": "null", "2 ^ 3": "8", "Round(2.5)": "3.0", "Round(-1.5)": "-2.0", "Truncate(-1.9)": "-1", "Floor(-1.5)": "-2", "Ceiling(1.1)": "2", "Abs(-5)": "5", "Power(2, 3)": "8", "Log(8, 2)": "3.0", "successor of 1": "2", "predecessor of 1.0": "0.99999999", "minimum Integer": "-2147483648", "10 'mg' * 2": "20 'mg'", "1 'g' + 500 'mg'": "1.5 'g'", "1 'g' > 500 'mg'": "true", "Precision(1.587)": "3", "LowBoundary(1.587, 8)": "1.587", "HighBoundary(1.587, 8)": "1.58799999"},
    "strings": {"'a' + 'b'": "'ab'", "'a' + null": "null", "'a' & null": "'a'", "Length('abc')": "3", "Substring('abc', 1)": "'bc'", "Substring('abc', 5)": "null", "PositionOf('b', 'abc')": "1", "LastPositionOf('a', 'aba')": "2", "Split('a,b', ',')": "{'a', 'b'}", "Combine({'a', null, 'b'}, '-')": "'a-b'", "Matches('abc', 'a.c')": "true", "ReplaceMatches('abc', 'b', 'x')": "'axc'", "Upper('a')": "'A'", "'abc'[1]": "'b'", "IndexOf({1, 2}, 2)": "1"},
    "dates": {"@2014-01-31 + 1 month": "@2014-02-28", "@2012-01-01 + 1 year": "@2013-01-01", "years between @2000-05-05 and @2010-05-04": "9", "difference in months between @2000-01-31 and @2000-02-01": "1", "@2012 < @2013": "true", "@2012 = @2012-05": "null", "@2012-01 before @2012-02-01": "true", "@2012 = @2012": "true", "year from @2012-05": "2012", "month from @2012": "null", "@2014-01-01T00:00:00.0 + 1 second = @2014-01-01T00:00:01.000": "true", "@T10:00:00.000 + 15 hours": "@T01:00:00.000", "(months between @2000 and @2001) > 1": "null", "(years between @2000 and @2010) > 5": "true", "@2012-05-05 same month as @2012-05-09": "true", "DateTime(2012, 3) same year as @2012-07-01T": "true", "@2012-01-01T10:00:00.000+01:00 = @2012-01-01T09:00:00.000Z": "true"},
    "intervals": {"3 in Interval[1, 5]": "true", "5 in Interval[1, 5)": "false", "Interval[1, 5] overlaps Interval[5, 9]": "true", "Interval[1, 4] meets Interval[5, 9]": "true", "Interval[1, 5] union Interval[6, 9]": "Interval[1, 9]", "Interval[1, 5] intersect Interval[3, 9]": "Interval[3, 5]", "Interval[1, 9] except Interval[5, 12]": "Interval[1, 4]", "Interval[1, 9] except Interval[3, 5]": "null", "width of Interval[1, 5]": "4", "start of Interval(1, 5]": "2", "end of Interval[1, 5)": "4", "Interval[1, 5] properly includes Interval[2, 3]": "true", "collapse {Interval[1, 3], Interval[4, 6], Interval[9, 9]}": "{Interval[1, 6], Interval[9, 9]}", "expand Interval[1, 4]": "{1, 2, 3, 4}", "expand {Interval[1, 4]} per 2": "{Interval[1, 2], Interval[3, 4]}", "Interval[1, 2] before Interval[4, 5]": "true", "@2012-01-05 3 days after @2012-01-02": "true", "@2012-01-05 2 days or more after @2012-01-02": "true", "@2012-01-05 less than 2 days after @2012-01-02": "false", "point from Interval[3, 3]": "3"},
    "lists": {"{1, 1, 2} union {2, 3}": "{1, 1, 2, 3}", "{1, 2, 3} intersect {3, 1}": "{1, 3}", "{1, 1, 4} except {4}": "{1, 1}", "distinct {1, null, 1, null}": "{1, null}", "flatten {{1}, {2, 3}}": "{1, 2, 3}", "exists {null}": "false", "exists {1}": "true", "First({1, 2})": "1", "Last({1, 2})": "2", "Take({1, 2, 3}, 2)": "{1, 2}", "Skip({1, 2, 3}, 2)": "{3}", "Tail({1, 2, 3})": "{2, 3}", "singleton from {1}": "1", "1 in {1, null}": "true", "2 in {1, null}": "false", "{1, 2} includes {1}": "true", "{1, 2, 3} properly includes {1}": "true", "{1, null} = {1, null}": "true", "{1, 2} ~ {2, 1}": "true", "({1, 2, 3}) x where x > 1 return x * 2": "{4, 6}", "from ({2, 3}) a, ({5}) b return a + b": "{7, 8}", "({3, 1, 2}) x sort desc": "{3, 2, 1}", "({1, 2}) x aggregate t starting 1: t * x": "2", "({1, 2, 3}) x with ({2, 3}) y such that x = y": "{2, 3}", "({1, 2, 3}) x without ({2, 3}) y such that x = y": "{1}", "({1, 2}) x let y: x + 1 return y": "{2, 3}"},
    "aggregates": {"Count({1, null})": "1", "Sum({1, 2, null})": "3", "Avg({1, 2})": "1.5", "Min({3, 1})": "1", "Max({'a', 'b'})": "'b'", "Median({1, 2, 3, 4})": "2.5", "Mode({1, 2, 2})": "2", "Variance({1.0, 2.0, 3.0, 4.0, 5.0})": "2.5", "PopulationVariance({1.0})": "null", "StdDev({1.0, 2.0, 3.0, 4.0, 5.0})": "1.58113883", "AllTrue({true, null})": "true", "AnyTrue({})": "false", "Product({2, 3})": "6", "GeometricMean({2.0, 8.0})": "4.0", "Sum({1 'ml', 2 'ml'})": "3 'ml'"},
    "types": {"ToInteger('12')": "12", "ToInteger('x')": "null", "ToDecimal('1.5')": "1.5", "ToBoolean('yes')": "true", "ToString(1.50)": "'1.5'", "ToQuantity('5 \\'mg\\'')": "5 'mg'", "1 is Integer": "true", "1 is String": "false", "convert 5 to String": "'5'", "ConvertsToInteger('x')": "false", "convert 1 'g' to 'mg'": "1000 'mg'", "Coalesce(null, 2)": "2", "if null then 1 else 2": "2", "case 2 when 1 then 'a' when 2 then 'b' else 'c' end": "'b'", "Tuple{a: 1, b: null} = Tuple{a: 2, b: null}": "false", "Tuple{a: 1}.a": "1", "Code{code: 'x', system: 's'} ~ Code{code: 'X', system: 'S'}": "true", "ToDate('2012-05') = @2012-05": "true"},
}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, now=dt.datetime(2020, 1, 1))


def lowered(engine, text):
    low = engine.lowerer(engine.parse(f'define "r": {text}'))
    return low.val(low.defines["r"].body, Scope(low, low.frame(None), None, None))


@pytest.mark.parametrize("family", sorted(CASES))
def test_values(spark, engine, family):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        checks, shown = [], []
        for text, want in CASES[family].items():
            a, b = lowered(engine, text), lowered(engine, want)
            checks.append((a.null & b.null) | F.coalesce(V.equal(a, b) if ANY not in (a.type, b.type) else F.lit(False), F.lit(False)))
            shown.append(text)
        bad = []
        for lo in range(0, len(checks), 8):
            row = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(checks[lo : lo + 8]))).first()
            bad += [t for t, ok in zip(shown[lo:], row) if not ok]
        assert not bad
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "true")


@pytest.mark.parametrize("text", ["1 +", "{1, 2", "Interval[1, 2", "define", "'abc"])
def test_syntax_errors(text):
    with pytest.raises(SyntaxFault):
        parse_expression(text)


@pytest.mark.parametrize("text", ["nothing", "1 + 'a'", "2147483648", "Unknown(1)", "5 and true", "Interval[5, 1]", "[Nowhere]", "start of 5"])
def test_semantic_errors(engine, text):
    with pytest.raises(SemanticFault):
        lowered(engine, text)


def test_check_reports_every_definition(engine):
    found = engine.check("define a: 1 + 'x'\ndefine b: 2\ndefine c: missing\ndefine d: d")
    assert [f.define for f in found] == ["a", "c", "d"]
    assert all(f.pos for f in found)


def test_run_time_errors(engine):
    for text in ("Ln(0)", "singleton from {1, 2}", "Message(1, true, '1', 'Error', 'no')"):
        with pytest.raises(EvaluationFault):
            engine.value(text)


def test_limits(spark):
    with pytest.raises(TooCostlyFault):
        Engine(spark, max_source=5).parse("define a: 1 + 2")
    with pytest.raises(TooCostlyFault):
        Engine(spark, max_depth=50).parse("define a: " + "(" * 100 + "1" + ")" * 100)


def test_library_parts():
    lib = parse_library("library L version '1' using M include O called P parameter X Integer default 3 define private a: X define fluent function f(a Integer) returns Integer: a + 1")
    assert (lib.name, lib.version, lib.includes[0].alias, lib.parameters[0].name, lib.functions[0].fluent) == ("L", "1", "P", "X", True)


def test_parameters_and_privacy(spark, engine):
    text = "parameter X Integer default 3\ndefine private hidden: X + 1\ndefine shown: hidden * 2"
    assert engine.evaluate(text, "shown").first()["value"] == 8
    assert engine.evaluate(text, "shown", {"X": 10}).first()["value"] == 22
    assert set(engine.evaluate(text)) == {"shown"}


def test_circular_include(spark):
    libs = {"A": "library A include B define x: 1", "B": "library B include A define y: 1"}
    with pytest.raises(LogicError):
        Engine(spark, libraries=libs).evaluate("include A define z: A.x", "z")
