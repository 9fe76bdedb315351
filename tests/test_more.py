"""ELM, resources, interval operators in set form, and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry.engine import Engine, Library
from cohortry.errors import SemanticFault
from cohortry.operators.ranges import merge_intervals, overlap_join
from cohortry.plans.elm import export_library, import_library
from cohortry.plans.syntax import parse_library
from cohortry.queries import queries
from cohortry.sources.fhir import fhir_model, read_resources
from cohortry.sources.model import sales_model
from cohortry.sources.terminology import Terminology
from cohortry.streaming.live import evaluate_stream

SF = "/root/testdata/sf0.001"
TEXT = """library T version '1'
parameter P Integer default 2
define a: ({1, 2, 3}) x where x > P - 1 return x * 2 sort desc
define b: Interval[1, 5] overlaps Interval[5, 9] and not (3 in {1, 2})
define c: case when P = 2 then 'two' else 'other' end
define d: Sum({1, 2, 3}) + Coalesce(null, 4)
define e: Tuple { n: 1, s: 'x' }.s
define function f(x Integer): x + 1
define g: f(P)
"""


def test_elm_round_trip(spark):
    engine = Engine(spark)
    tree = import_library(export_library(parse_library(TEXT)))
    for name in "abcdeg":
        want, got = (engine.evaluate(Library(t, TEXT), name).first()["value"] for t in (parse_library(TEXT), tree))
        assert got == want, name


def test_resources(spark, tmp_path):
    rows = [
        '{"resourceType": "Patient", "id": "p1", "birthDate": "1980-05-05"}',
        '{"resourceType": "Patient", "id": "p2", "birthDate": "2010"}',
        '{"resourceType": "Observation", "id": "o1", "status": "final", "subject": {"reference": "Patient/p1"}, "code": {"coding": [{"system": "s", "code": "c"}]}, "effectiveDateTime": "2020-01-05", "valueQuantity": {"value": 5.5, "unit": "mg"}}',
        '{"resourceType": "Observation", "id": "o2", "status": "draft", "subject": {"reference": "Patient/p1"}, "effectiveDateTime": "2021"}',
    ]
    (tmp_path / "r.json").write_text("\n".join(rows))
    tables = {k: read_resources(spark, str(tmp_path), k) for k in ("Patient", "Observation")}
    engine = Engine(spark, fhir_model(tables), now=dt.datetime(2020, 5, 4))
    text = """context Patient
define n: Count([Observation] O where O.status = 'final')
define age: AgeInYears()
define last: Last([Observation] O sort by id).id
define early: Count([Observation] O where ToDateTime(O.effectiveDateTime) before @2020-06-01T)
"""
    get = lambda name: {r["subject"]: r["value"] for r in engine.evaluate(text, name).collect()}
    assert get("n") == {"p1": 1, "p2": 0}
    assert get("last") == {"p1": "o2", "p2": None}
    assert get("early") == {"p1": 1, "p2": 0}
    ages = get("age")
    assert ages["p1"]["low"] == ages["p1"]["high"] == 39 if not isinstance(ages["p1"], int) else ages["p1"] == 39


def test_overlap_join_and_merge(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("INTERVAL 45 DAY")).alias("hi"))
    p = o.toDF("key2", "o_custkey", "lo2", "hi2")
    got = overlap_join(o, p, "lo", "hi", "lo2", "hi2", on=["o_custkey"]).select("o_orderkey", "key2")
    q = p.withColumnRenamed("o_custkey", "c2")
    want = o.join(q, (F.col("o_custkey") == F.col("c2")) & (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))).select("o_orderkey", "key2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    semi = overlap_join(o, p.where("key2 % 7 = 0"), "lo", "hi", "lo2", "hi2", on=["o_custkey"], how="left_semi")
    assert semi.count() == want.where("key2 % 7 = 0").select("o_orderkey").distinct().count()
    merged = merge_intervals(o, ["o_custkey"], "lo", "hi")
    assert merged.count() < o.count() and merged.where("lo > hi").count() == 0


def test_stream(spark, tmp_path):
    engine = Engine(spark, sales_model(spark, SF))
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(f"{SF}/orders.parquet").schema
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    text = "context Unfiltered\ndefine q: [Orders] O where O.o_orderstatus = 'F' return O.o_orderkey"
    live = evaluate_stream(engine, "Order", source, text, "q")
    run = live.writeStream.format("memory").queryName("live_orders").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.sql("SELECT count(*) AS n FROM live_orders").first()["n"] == engine.evaluate(text, "q").count()


def test_retrieve_guard_counts_rows_of_a_retrieve(spark):
    from cohortry.errors import TooCostlyFault
    from cohortry.sources.model import sales_model

    text = "define Q: Count([Orders])"
    folder = "/root/testdata/sf0.001"
    with pytest.raises(TooCostlyFault):
        Engine(spark, sales_model(spark, folder), max_retrieve=10).evaluate(text, "Q")
    guarded = Engine(spark, sales_model(spark, folder), max_retrieve=2000)
    assert guarded.evaluate(text, "Q").collect()[0]["value"] == 1500
    assert Engine(spark, sales_model(spark, folder), max_retrieve=10).check(text) == []


def test_value_sets_of_any_size_inside_expressions(spark):
    sets = [("v", "s", f"Brand#{k}", "") for k in range(20, 620)] + [("v", None, "n", ""), ("w", "s", "Brand#21", ""), ("w", None, "n", "")]
    closure = [("s", f"c{k}", f"p{k % 50}") for k in range(3000)]
    terms = Terminology(spark.createDataFrame(sets, "url string, system string, code string, display string"), spark.createDataFrame(closure, "system string, code string, ancestor string"))
    rows = [("s", "Brand#21"), ("s", "Brand#9"), (None, "Brand#21"), (None, "n"), ("s|", "n"), ("s", None), ("s|Brand#21", "")]
    df = spark.createDataFrame(rows, "system string, code string").select(F.struct("system", "code").alias("c"))
    for url in ("v", "w"):
        member, known = terms.test(url), {(s, c) for u, s, c, _ in sets if u == url}
        got = df.select("c", member(F.col("c")).alias("m"), F.exists(F.array("c"), member).alias("e")).collect()
        assert all(r["m"] == r["e"] == (tuple(r["c"]) in known) for r in got)
    code = lambda c: F.struct(F.lit("s").alias("system"), F.lit(c).alias("code"))
    above = terms.subsumes()
    assert spark.range(1).select(above(code("p7"), code("c57")), above(code("p7"), code("c58"))).head() == (True, False)


def test_aggregates_of_one_table_share_its_scan(spark):
    plan = queries()["agg_variance"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_casts_that_fail_and_intervals_against_lists(spark):
    engine = Engine(spark, sales_model(spark, SF))
    value = lambda e: engine.evaluate(f"define x: {e}", "x").head()["value"]
    assert value("cast 1 as Integer") == 1 and value("cast (null as String) as Integer") is None
    with pytest.raises(Exception, match="cast"):
        value("cast 'a' as Integer")
    with pytest.raises(SemanticFault):
        value("Interval[1, 5] includes {2, 3}")
    assert value("{Interval[1, 5]} includes Interval[1, 5]") is True
