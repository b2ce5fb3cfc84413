"""Reports and gates by name."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sedimenta import api


@pytest.fixture(scope="module")
def functions(spark):
    rows = [("a.ts", "f", 1, 9, 9, 20, 3, 1, 1.0), ("a.ts", "g", 10, 20, 11, 1, 2, 0, None), ("b.ts", "h", 1, 5, 5, 1, 1, 0, 1.0)]
    return spark.createDataFrame(rows, "path string, fn string, start int, end int, loc int, cognitive int, cyclomatic int, nesting int, coverage double")


def test_check_gate(functions):
    gate = api.check(functions)
    assert sorted((r.fn, r.reasons) for r in gate.violations.collect()) == [("f", ["cognitive"]), ("g", ["crap_unavailable"])]
    with pytest.raises(api.GateFailed, match="check"):
        gate.enforce()
    hidden = functions.withColumn("hide", F.array(F.lit("cognitive"), F.lit("crap")))
    api.check(hidden, suppressed="hide").enforce()


def test_baseline_and_debt(functions):
    worse = functions.withColumn("cognitive", F.col("cognitive") + 2)
    assert api.baseline(functions, worse, {"cognitive": 2}).holds()
    assert not api.baseline(functions, worse, {"cognitive": 1}).holds()
    got = api.debt(functions, functions.where("fn <> 'f'"), {"cognitive": 15})
    assert [(r.fn, r.transition) for r in got.collect()] == [("f", "resolved")]
    assert api.changed(functions, worse, "cognitive").count() == 3


def test_dependencies_impact_and_unused(spark):
    files = spark.createDataFrame([("a.ts", 'import "./b"; import "./gone"'), ("b.ts", 'import "./c"'), ("c.ts", ""), ("d.ts", "")], "path string, text string")
    edges, open_, fan = api.dependencies(files)
    assert sorted(map(tuple, edges.select("source", "target").collect())) == [("a.ts", "b.ts"), ("b.ts", "c.ts")]
    assert [r.specifier for r in open_.collect()] == ["./gone"]
    assert fan.where("node = 'b.ts'").first()[1:] == (1, 1)
    assert [tuple(r) for r in api.impact(edges, "c.ts").collect()] == [("b.ts", 1), ("a.ts", 2)]
    assert [r.node for r in api.unused(files.select(F.col("path").alias("node")), edges, spark.createDataFrame([("a.ts",)], "node string")).collect()] == ["d.ts"]


def test_plan_gate_and_summary(spark, functions):
    plan = lambda cost: spark.createDataFrame([("q.json", json.dumps([{"Plan": {"Node Type": "Result", "Total Cost": cost}}]))], "file string, text string")
    assert api.sql_plan(plan(10), plan(11)).holds()
    assert not api.sql_plan(plan(10), plan(20)).holds()
    assert api.repo_summary(functions, 1).where("key = 'crap'").count() == 1
    assert api.function(functions, "a.ts", "f").select("crap").first()[0] == 3.0


def test_security_gate(spark):
    f = spark.createDataFrame([("r", "p", "high"), ("s", "p", "low")], "rule string, path string, severity string")
    assert not api.security_report(f).holds()
    assert api.security_report(f, f).holds()
    assert api.security_report(f, f.where("rule = 's'")).violations.count() == 1


def test_project_risk_and_gates(spark, functions):
    files = spark.createDataFrame([("a.ts", "typescript", 1), ("b.ts", "typescript", 0)], "path string, language string, parse_errors int")
    project = api.Project(files, api.analyze(functions).withColumnRenamed("fn", "id"))
    assert api.project_summary(project).select("files", "functions", "parse_errors").first()[:] == (2, 3, 1)
    found = spark.createDataFrame([(1, "a.ts", 12), (2, "b.ts", 9), (3, None, None)], "finding_id int, path string, line int")
    assert sorted((r.finding_id, r.function_id, r.reason) for r in api.enriched(found, project).collect()) == [(1, "g", None), (2, None, "no-function-at-location"), (3, None, "no-path")]
    gate = api.quality_gate(functions, {"cognitive": 15}, {"maintainability_rating": "D", "security_rating": "A", "effort_minutes": 40})
    assert [r.metric for r in gate.violations.collect()] == ["security_rating"]
    assert api.explain_metric(spark, "crap").first().unit == "points"
    assert api.explain_metric(spark).count() == 8
    sql = spark.createDataFrame([("q.sql", "UPDATE t SET a = 1"), ("r.sql", "SELECT a FROM t WHERE b LIKE '%x'")], "path string, text string")
    assert [r.path for r in api.sql_gate(sql).violations.collect()] == ["q.sql"]
    assert api.sql_gate(sql, "medium").violations.count() == 2
    edges = spark.createDataFrame([("b.ts", "a.ts")], "source string, target string")
    nodes = files.select(F.col("path").alias("node"))
    assert sorted((r.node, r.blast_radius) for r in api.impact_counts(edges, nodes).collect()) == [("a.ts", 1), ("b.ts", 0)]
    assert set(api.__all__) <= set(dir(api))
