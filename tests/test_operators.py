"""Small cases with results worked out by hand: nulls, ties, empty inputs, and what the operators promise."""

from __future__ import annotations

import inspect
import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M
from sedimenta.functions import paths as P
from sedimenta.operators import code, drift, graph, history, queryplans, security, snapshots, spans, telemetry, triage
from sedimenta.sources import reports, sinks
from sedimenta.streaming import events as streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_co_change_counts_pairs_and_totals(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "b")], "commit int, path string")
    got = {(r.source, r.target): (r.co_changes, r.forward, r.backward, r.jaccard) for r in history.coupling(files, least=1).collect()}
    assert got == {("a", "b"): (2, 1.0, 1.0, 1.0), ("a", "c"): (1, 0.5, 1.0, 0.5), ("b", "c"): (1, 0.5, 1.0, 0.5)}


def test_wide_commits_count_but_make_no_pairs(spark):
    wide = spark.createDataFrame([(1, f"f{i:02d}") for i in range(51)] + [(2, f"f{i:02d}") for i in range(50)], "commit int, path string")
    got = history.coupling(wide, least=1)
    assert got.count() == 50 * 49 // 2
    assert got.where("source = 'f00' AND target = 'f01'").select("co_changes", "source_changes").first() == (1, 2)


def test_pair_ceiling_gives_nothing_instead_of_a_part(spark):
    files = spark.createDataFrame([(1, c) for c in "abcd"], "commit int, path string")
    assert history.coupling(files, least=1, ceiling=6).count() == 6
    assert history.coupling(files, least=1, ceiling=5).count() == 0


def test_no_pair_ceiling_unless_one_is_given(spark):
    files = spark.createDataFrame([(1, c) for c in "abcd"], "commit int, path string")
    assert inspect.signature(history.coupling).parameters["ceiling"].default is None  # a billion pairs are too many for a test
    assert history.coupling(files, least=1).count() == 6


def test_bus_factor_goes_by_half_of_the_touches(spark):
    t = spark.createDataFrame([("p", "x", 5), ("p", "y", 3), ("p", "z", 2), ("q", "x", 1)], "path string, identity string, touches long")
    assert rows(history.concentration(t)) == [("p", 3, 10, "x", 50.0, 1), ("q", 1, 1, "x", 100.0, 1)]


def test_recency_counts_the_last_day(spark):
    c = spark.createDataFrame([(1, "2024-01-31 00:00:00", "a"), (2, "2024-01-01 00:00:00", "a"), (3, "2023-12-31 23:59:59", "b")], "commit int, ts string, identity string").withColumn("ts", F.to_timestamp("ts"))
    f = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "commit int, path string").withColumns({"lines_added": F.lit(1), "lines_deleted": F.lit(0)})
    r = history.facts(c, f).first()
    assert (r.changes_30d, r.changes_90d, r.contributors) == (2, 3, 2)


def test_empty_inputs(spark):
    files = spark.createDataFrame([], "commit int, path string")
    edges = spark.createDataFrame([], "source int, target int, kind string")
    nodes = spark.createDataFrame([], "node int")
    assert history.coupling(files).count() == 0
    assert graph.cycles(edges).count() == 0
    assert graph.distances(edges, nodes).count() == 0
    assert graph.fan(nodes, edges).count() == 0
    assert triage.equal_width(spark.createDataFrame([], "v double"), "v").where("n > 0").count() == 0


def test_mailmap_forms_and_precedence(spark):
    lines = spark.createDataFrame([(1, "Proper <p@x>"), (2, "# no"), (3, "Ann <ann@x> <old@x>"), (4, "Bob <bob@x> Robert <old@x>")], "ord int, row string")
    rules = reports.mailmap(lines)
    commits = spark.createDataFrame([("Robert", "OLD@x"), ("Ann", "old@x"), ("Z", "Z@x")], "author string, email string")
    got = {r.author: r.identity for r in history.resolved_identities(commits, rules).collect()}
    assert got == {"Robert": "bob@x", "Ann": "ann@x", "Z": "z@x"}


def test_unknown_is_not_zero(spark):
    f = spark.createDataFrame([(3, 2, None), (9, 2, 31.0), (9, 2, 30.0)], "cognitive int, cyclomatic int, crap double")
    limits = {"cognitive": 8, "crap": 30.0}
    assert [r[0] for r in f.select(M.violation_reasons(limits)).collect()] == [["crap_unavailable"], ["cognitive", "crap"], ["cognitive"]]
    assert [r[0] for r in f.select(M.effort(limits)["crap"]).collect()] == [0, 12, 0]
    hidden = f.select(M.unsuppressed(M.violation_reasons(limits), F.array(F.lit("crap"))))
    assert [r[0] for r in hidden.collect()] == [[], ["cognitive"], ["cognitive"]]


def test_scores_and_severities(spark):
    one = spark.range(1)
    risk = M.weighted_score({"complexity": F.lit(50.0), "churn": F.lit(None).cast("double")})
    assert one.select(risk).first()[0] == 50.0
    assert one.select(M.weighted_score({"churn": F.lit(None).cast("double")})).first()[0] == 0.0
    scores = spark.createDataFrame([(s,) for s in (None, -1.0, 0.0, 3.9, 4.0, 7.0, 9.0, 11.0)], "s double")
    assert [r[0] for r in scores.select(M.severity_of_score(F.col("s"))).collect()] == ["unknown", "low", "low", "low", "medium", "high", "critical", "critical"]
    labels = spark.createDataFrame([(x,) for x in ("Error", "warning", "NOTE", "important", "info", None)], "s string")
    assert [r[0] for r in labels.select(M.severity_of_label(F.col("s"))).collect()] == ["high", "medium", "low", "unknown", "unknown", "unknown"]
    assert one.select(M.maintainability_rating(F.lit(9), F.lit(0))).first()[0] == "A"
    zero = {s: F.lit(0) for s in M.SEVERITIES}
    assert one.select(M.security_rating(zero)).first()[0] == "A"
    assert one.select(M.security_rating(zero | {"unknown": F.lit(2)})).first()[0] is None


def test_transitions_tell_absent_from_unknown(spark):
    before = spark.createDataFrame([("a", 1, 9.0), ("b", 1, None), ("c", 1, 9.0)], "name string, at int, m double")
    after = spark.createDataFrame([("a", 1, 9.0), ("b", 1, 9.0), ("d", 1, 9.0)], "name string, at int, m double")
    got = drift.transitions(drift.paired(before, after, ["name"], ["at"]), ["name"], {"m": 5.0})
    assert rows(got.select("name", "transition")) == [("a", "existing"), ("b", "unknown"), ("c", "resolved"), ("d", "new")]


def test_repeated_names_pair_in_order(spark):
    before = spark.createDataFrame([("f", 10, 1), ("f", 20, 2)], "name string, at int, m int")
    after = spark.createDataFrame([("f", 15, 1), ("f", 25, 5), ("f", 30, 7)], "name string, at int, m int")
    got = drift.paired(before, after, ["name"], ["at"])
    assert rows(got.select("nth", "before_m", "after_m", drift.direction(["m"]))) == [(1, 1, 1, "unchanged"), (2, 2, 5, "regressed"), (3, None, 7, None)]


def test_drift_takes_null_keys_as_keys(spark):
    b = spark.createDataFrame([(None, 1), ("x", 1)], "k string, v int")
    a = spark.createDataFrame([(None, 1), ("y", 1)], "k string, v int")
    assert rows(drift.keyed_drift(b, a, ["k", "v"])) == [("x", 1, "resolved"), ("y", 1, "new"), (None, 1, "existing")]


def test_innermost_span_and_ambiguity(spark):
    points = spark.createDataFrame([("p", 5), ("p", 25), ("p", 99)], "path string, line int")
    s = spark.createDataFrame([("p", 0, 50, "outer"), ("p", 3, 9, "b"), ("p", 4, 10, "a"), ("p", 20, 30, "in")], "path string, start int, end int, id string")
    pairs = spans.containing(points, s, "path", "line", "start", "end", 4)
    assert rows(spans.innermost(pairs, ["path", "line"], "start", "end", "id").select("line", "id")) == [(25, "in"), (5, "a")]
    assert rows(spans.unique_innermost(pairs, ["path", "line"], "start", "end", "id").select("line", "id", "state")) == [(25, "in", "resolved"), (5, None, "ambiguous")]


def test_intervals_that_touch_by_one_stay_apart(spark):
    i = spark.createDataFrame([("p", 1, 5), ("p", 5, 8), ("p", 9, 10), ("p", 2, 3)], "path string, s int, e int")
    assert rows(spans.interval_union(i, "path", "s", "e")) == [("p", 1, 8), ("p", 9, 10)]


def test_suffix_match_is_unique_or_nothing(spark):
    known = spark.createDataFrame([("a/x/f.c",), ("b/x/f.c",), ("c/g.c",), ("g.c",)], "path string")
    asked = spark.createDataFrame([("x/f.c",), ("a/x/f.c",), ("g.c",), ("none",)], "reported string")
    assert {r.reported: r.path for r in spans.by_suffix(asked, known).collect()} == {"x/f.c": None, "a/x/f.c": "a/x/f.c", "g.c": "g.c", "none": None}


def test_cycles_equal_a_search(spark):
    random.seed(5)
    pairs = {(random.randrange(40), random.randrange(40)) for _ in range(55)} | {(41, 42), (42, 41), (50, 50)}
    reach = {n: {n} for e in pairs for n in e}
    for _ in range(50):
        for a, b in pairs:
            for r in reach.values():
                if a in r:
                    r.add(b)
    expected = {}
    for n in reach:
        own = {m for m in reach[n] if n in reach[m]}
        if len(own) > 1:
            expected[n] = min(own)
    edges = spark.createDataFrame(sorted(pairs), "source int, target int")
    for one_task in (0, 1000):
        assert {r.node: r.cycle for r in graph.cycles(edges, one_task=one_task).collect()} == expected


@pytest.mark.parametrize("reverse", [False, True])
def test_distances_by_rounds_and_by_one_task_are_the_same(spark, reverse):
    random.seed(11)
    pairs = {(f"n{random.randrange(30)}", f"n{random.randrange(30)}") for _ in range(45)}
    edges = spark.createDataFrame(sorted(pairs), "source string, target string")
    starts = spark.createDataFrame([("n1",), ("n2",), ("n2",), ("elsewhere",)], "node string")
    expected = set()
    for s in ("n1", "n2", "elsewhere"):
        seen, now, d = {s}, {s}, 0
        while now:
            expected |= {(s, n, d) for n in now}
            now = {y if not reverse else x for x, y in pairs if (x if not reverse else y) in now} - seen
            seen |= now
            d += 1
    for one_task in (0, 1000):
        got = [tuple(r) for r in graph.distances(edges, starts, reverse, one_task=one_task).collect()]
        assert len(got) == len(set(got))
        assert set(got) == expected
        assert {r.node for r in graph.reached(edges, starts, reverse, one_task=one_task).collect()} == {n for _, n, _ in expected}


@pytest.mark.parametrize("small", [True, False])
def test_impact_counts_by_one_task_and_by_rounds(spark, monkeypatch, small):
    """a and b depend on each other, c on a, d on c; e stands alone."""
    if not small:
        monkeypatch.setattr(graph, "COUNTED_EDGES", 0)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("d", "c"), ("e", "e")], "source string, target string")
    nodes = spark.createDataFrame([(n,) for n in "abcdee"], "node string")
    assert rows(graph.impact_counts(edges, nodes)) == [("a", 2, 3, 75.0), ("b", 1, 3, 75.0), ("c", 1, 1, 25.0), ("d", 0, 0, 0.0), ("e", 0, 0, 0.0)]
    assert rows(graph.impact_counts(edges.limit(0), nodes.where("node = 'e'"))) == [("e", 0, 0, 0.0)]


def test_selection_ladder_by_hand(spark):
    """A lock file selects all, a document nothing, what can't be reasoned about its directory, the rest by the graph."""
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    files = spark.createDataFrame([("x/a.py", False, False), ("x/b.py", False, False), ("y/c.py", False, False), ("y/broken.py", True, False), ("z/lone.py", False, False), ("x/test_a.py", False, True), ("y/inline.py", False, True)], "path string, parse_error boolean, declares_tests boolean")
    tests = paths("x/test_a.py", "y/test_c.py", "z/test_z.py", "test_root.py")
    edges = spark.createDataFrame([("x/test_a.py", "x/b.py"), ("x/b.py", "x/a.py"), ("y/inline.py", "y/c.py")], "source string, target string")
    pick = lambda *changed: rows(graph.select_tests(paths(*changed), tests, files, edges, ("*.lock",)))
    assert pick("x/a.py") == [("x/test_a.py", "graph", "x/a.py")]
    assert pick("x/test_a.py") == [("x/test_a.py", "graph", "x/test_a.py")]
    assert pick("y/c.py") == [("y/inline.py", "graph", "y/c.py")]
    assert pick("README.md", "docs/a.PNG") == []
    assert pick("z/lone.py") == [("z/test_z.py", "directory", "z/lone.py")]
    assert pick("y/broken.py", "x/a.py") == [("x/test_a.py", "graph", "x/a.py"), ("y/test_c.py", "directory", "y/broken.py")]
    assert [r[:2] for r in pick("Makefile")] == [(t, "directory") for t in ("test_root.py", "x/test_a.py", "y/test_c.py", "z/test_z.py")]
    assert pick("a.lock", "x/a.py")[1] == ("x/test_a.py", "all", "a.lock,x/a.py")
    totals = lambda *changed: graph.selection_totals(paths(*changed), tests, files, edges, ("*.lock",)).first()[:]
    assert totals("y/c.py") == (5, 1, 0.2, None, "")
    assert totals("z/gone.py", "w/x.odd") == (4, 1, 0.25, "directory", "not in graph: z/gone.py;unsupported extension: w/x.odd")
    assert totals("a.lock") == (4, 4, 1.0, "all", "always run: a.lock")
    assert totals("a.md") == (4, 0, 0.0, None, "")


def test_risk_by_hand(spark):
    """All six components known; then no changes, no coverage and no owner, which drop out of the weights."""
    files = spark.createDataFrame([("a", 15, 18, 12.0), ("b", 3, 2, None)], "path string, cognitive int, cyclomatic int, crap double")
    changes = spark.createDataFrame([("a", 5)], "path string, changes long")
    impact = spark.createDataFrame([("a", 40.0), ("b", 10.0)], "path string, blast_radius_percent double")
    owners = spark.createDataFrame([("a", 60.0)], "path string, concentration double")
    violations = spark.createDataFrame([("a", "info"), ("a", "warning")], "path string, severity string")
    from sedimenta.operators import risk

    got = {r.path: r for r in risk.rows(files, changes, impact, owners, violations).collect()}
    assert got["a"][1:] == (52.0, 90.0, 40.0, 25.0, 40.0, 60.0, 60.0)
    assert (got["b"].score, got["b"].crap, got["b"].churn, got["b"].policy) == (round((10 * 20 + 10 * 20) / 55, 4), None, None, 0.0)
    assert [(r.path, r.place) for r in risk.ranked(risk.rows(files, changes, impact, owners, violations)).collect()] == [("a", 1), ("b", 2)]


def test_quality_gate_fails_closed(spark):
    from sedimenta.operators import gates

    f = spark.createDataFrame([(9, 100)], "cognitive int, loc int")
    conditions = {"maintainability_rating": "A", "security_rating": "B", "effort_minutes": 7}
    low = spark.createDataFrame([("low",)], "severity string")
    assert rows(gates.quality_gate(f, {"cognitive": 8}, conditions, low)) == [("effort_minutes", "7", "8", False, False), ("maintainability_rating", "A", "A", True, False), ("security_rating", "B", "B", True, False)]
    assert [r.passed for r in gates.quality_gate(f, {}, {"maintainability_rating": "E", "security_rating": "E"}).collect()] == [False, False]
    assert gates.quality_gate(f.limit(0), {"cognitive": 8}, {"maintainability_rating": "A", "effort_minutes": 0}).first().gate


def test_statuses_and_judgments(spark):
    raw = ["run_error", "TimedOut", "PENDING", "pending ", None, "No-Coverage"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in raw], "r string").select(security.mutation_status(F.col("r"))).collect()] == ["error", "timed_out", "ignored", "unknown", "unknown", "no_coverage"]
    j = spark.createDataFrame([(1.0, None, None, None), (1.0, "core_domain", 3.0, 0.5), (1.0, "odd", 0.0, 1.0)], "w double, role string, inherent double, attention double")
    assert [round(r[0], 6) for r in j.select(triage.priority(*map(F.col, j.columns))).collect()] == [0.3, 0.09, 0.5]
    b = spark.createDataFrame([(0.39, 0.1), (0.4, 0.59), (None, 0.5), (0.9, None), (None, None)], "a double, c double")
    assert [r[0] for r in b.select(triage.bucket(F.col("a"), F.col("c"))).collect()] == ["accept", "review", "review", "act", "act"]


def test_quantiles_by_hand(spark):
    e = spark.createDataFrame([("a", 0.5), ("a", 3.0), ("a", 3.0), ("a", 900.0)], "k string, v double")
    h = telemetry.cumulative(e, "k", "v", (1.0, 5.0))
    assert rows(telemetry.quantiles(h, "k", (0.25, 0.5, 1.0))) == [("a", 0.25, 1.0), ("a", 0.5, 3.0), ("a", 1.0, 5.0)]
    assert rows(telemetry.buckets(h, "k")) == [("a", 1.0, 1), ("a", 5.0, 2), ("a", None, 1)]


def test_normalisation_of_equal_values(spark):
    assert [r.normalized for r in triage.normalized(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()] == [0.5, 0.5]


def test_evidence_has_three_values(spark):
    f = spark.createDataFrame([("npm", "a"), ("npm", "b"), ("pypi", "a")], "ecosystem string, package string")
    i = spark.createDataFrame([("a", "x.js"), ("a", "w.js")], "package string, file string")
    assert rows(security.reachable(f, i).select("ecosystem", "package", "reachable", "evidence")) == [("npm", "a", True, "w.js,x.js"), ("npm", "b", False, None), ("pypi", "a", None, None)]


def test_paths(spark):
    p = spark.createDataFrame([("a/./b/../c.ts",), ("../x",), ("a\\b.PY",), ("vendor/x.c",)], "p string")
    assert [r[0] for r in p.select(P.normalized(F.col("p"))).collect()] == ["a/c.ts", None, "a/b.PY", "vendor/x.c"]
    assert [r[0] for r in p.select(P.language(F.col("p"))).collect()] == ["typescript", None, "python", "c"]
    globs = spark.createDataFrame([("src/a.min.js",), ("build/x/y",), ("src/build.c",)], "p string")
    assert [r[0] for r in globs.select(P.matches(F.col("p"), ("*.min.js", "/build/"))).collect()] == [True, True, False]


def test_lcov_and_xml(spark):
    lcov = "TN:\nSF:a.c\nDA:1,2\nDA:2,0\nBRDA:2,0,0,1\nBRDA:2,0,1,-\nend_of_record\nDA:9,9\nSF:../b.c\nDA:1,1\nend_of_record\nSF:a.c\nDA:1,1\nend_of_record"
    hits, branches = reports.lcov(spark.createDataFrame([("r", lcov)], "file string, text string"))
    assert rows(hits) == [("a.c", 1, 3), ("a.c", 2, 0)]
    assert rows(branches) == [("a.c", 2, 2, 1)]
    jacoco = '<report name="x"><package name="p"><sourcefile name="A.java"><line nr="3" mi="0" ci="4" mb="1" cb="1"/></sourcefile></package></report>'
    cobertura = '<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="2" condition-coverage="75% (3/4)"/></lines></class></classes></package></packages></coverage>'
    texts = spark.createDataFrame([("j", jacoco), ("c", cobertura)], "file string, text string")
    assert rows(texts.select("file", reports.xml_dialect(F.col("text")))) == [("c", "cobertura"), ("j", "jacoco")]
    assert [rows(x) for x in reports.jacoco(texts.where("file = 'j'"))] == [[("p/A.java", 3, 4)], [("p/A.java", 3, 2, 1)]]
    assert [rows(x) for x in reports.cobertura(texts.where("file = 'c'"))] == [[("a.py", 1, 2)], [("a.py", 1, 4, 3)]]


def test_scanner_reports(spark):
    def one(x):
        return spark.createDataFrame([("f.json", json.dumps(x))], "file string, text string")

    log = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "r", "properties": {"security-severity": "9.7"}}]}}, "results": [
        {"ruleId": "r", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file:///a/%62.c"}, "region": {"startLine": 4}}}]},
        {"ruleId": "q", "level": "note", "baselineState": "new", "partialFingerprints": {"x": "1"}},
    ]}]}
    got = reports.sarif(one(log)).select("rule", "severity", "state", "fingerprint", "path", "start_line", "end_line")
    assert rows(got) == [("q", "low", "new", "1", None, None, None), ("r", "critical", "unknown", None, "a/b.c", 4, 4)]
    osv = {"results": [{"source": {"path": "lock"}, "packages": [{"package": {"name": "n", "version": "1", "ecosystem": "npm"}, "vulnerabilities": [{"id": "V", "severity": [{"type": "CVSS", "score": "CVSS:3"}, {"type": "n", "score": "7.5"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2"}]}]}]}]}]}]}
    assert rows(reports.osv(one(osv))) == [("lock", "npm", "n", "1", "V", "high", "2")]
    trivy = {"Results": [{"Target": "t", "Type": "npm", "Vulnerabilities": [{"VulnerabilityID": "V", "PkgName": "n", "InstalledVersion": "1", "Severity": "HIGH"}]}, {"Target": "u", "Type": "npm"}]}
    assert rows(reports.trivy(one(trivy))) == [("t", "npm", "n", "1", "V", "high", "")]
    stryker = {"schemaVersion": "1.0", "files": {"a.js": {"mutants": [{"id": "1", "status": "NoCoverage", "mutatorName": "M", "location": {"start": {"line": 2, "column": 1}, "end": {"line": 2, "column": 3}}}]}}}
    assert rows(reports.stryker(one(stryker))) == [("a.js", 2, "M", "no_coverage", "1")]
    pit = "<mutations><mutation detected='true' status='KILLED'><sourceFile>A.java</sourceFile><lineNumber>3</lineNumber><mutator>x.y.Math</mutator><index>1</index></mutation></mutations>"
    assert rows(reports.pit(spark.createDataFrame([("p", pit)], "file string, text string"))) == [("A.java", 3, "Math", "killed", "1")]
    tests = {"schema_version": 2, "recorder": "r", "relationships": [{"test_id": "t", "symbol_key": "s", "target_path": "p"}]}
    assert rows(reports.test_map(one(tests))) == [("t", "s", None, "p")]
    with pytest.raises(reports.Invalid):
        reports.test_map(one(tests | {"schema_version": 1}))
    with pytest.raises(Exception, match="SARIF 2.1"):
        reports.sarif(one({"version": "1.0", "runs": []})).collect()


def test_commit_log(spark):
    log = ["@h1|Ann|ann@x|86400", "3\t1\tsrc/a.c", "-\t-\tlogo.png", "1\t0\tsrc/{old => new}/b.c"]
    df = spark.createDataFrame([("log", i, r) for i, r in enumerate(log)], "file string, n int, row string")
    assert rows(reports.numstat(df).select("commit", "email", "path", "added", "deleted")) == [("h1", "ann@x", "logo.png", None, None), ("h1", "ann@x", "src/a.c", 3, 1), ("h1", "ann@x", "src/new/b.c", 1, 0)]


def test_plans_by_hand(spark):
    def plan(kind, cost, estimated=7, actual=21, rows_=4):
        leaf = {"Node Type": kind, "Relation Name": "t", "Plan Rows": estimated, "Actual Rows": actual, "Actual Loops": 5}
        return json.dumps([{"Plan": {"Node Type": "Sort", "Total Cost": cost, "Plan Rows": rows_, "Plans": [leaf]}}])

    side = lambda *x: queryplans.facts(queryplans.flattened(spark.createDataFrame([("q.json", plan(*x))], "file string, text string")))
    assert side("Seq Scan", 5).select("cost", "sorts", "seq_only", "fast_scans", "q_error", "unbounded").first() == (5.0, 1, "t", "", 3.0, False)
    assert side("Seq Scan", 5, 0, 9).select("q_error", "unbounded").first() == (None, True)
    assert side("Seq Scan", 5, 0, 0).select("q_error", "unbounded").first() == (1.0, False)
    assert side("Bitmap Heap Scan", 5).select("seq_only", "fast_scans").first() == ("", "t")
    told = lambda b, a, **x: [tuple(r) for r in queryplans.regressions(b, a, **x).select("change", "relation", "detail", "fails").collect()]
    assert told(side("Index Scan", 10), side("Seq Scan", 10)) == [("index_to_sequential_scan", "t", "index scan replaced by sequential scan", True)]
    assert told(side("Seq Scan", 0), side("Seq Scan", 1)) == [("cost_increase", None, "unbounded increase from zero baseline", True)]
    assert told(side("Seq Scan", 10), side("Seq Scan", 11)) == [("cost_increase", None, "+10.0%", False)]
    assert told(side("Seq Scan", 10), side("Seq Scan", 9)) == [("cost_increase", None, "cost decreased", False)]
    assert told(side("Seq Scan", 1, 7, 21, 0), side("Seq Scan", 1)) == [("row_growth", None, "unbounded growth from zero baseline", True)]
    assert told(side("Seq Scan", 1), side("Seq Scan", 1, 7, 21, 2)) == [("row_growth", None, "decreased to 0.50x", False)]
    assert told(side("Seq Scan", 1, 1, 900), side("Seq Scan", 1, 1, 900)) == [("estimate_error", None, "900.0x", True)]
    assert told(side("Seq Scan", 1, 1, 900), side("Seq Scan", 1, 1, 900), most_q_error=None) == [(None, None, None, False)]
    nested = side("Seq Scan", 10).withColumn("nested_loop", F.lit(2).cast("long")).withColumn("sorts", F.lit(3).cast("long"))
    structural = [("added_sort", None, "sort nodes 1 -> 3"), ("join_strategy_change", None, "Nested Loop: 0 -> 2")]
    assert told(side("Seq Scan", 10), nested) == [(*s, False) for s in structural]
    assert told(side("Seq Scan", 1), nested) == [("cost_increase", None, "+900.0%", True), *((*s, True) for s in structural)]


def test_sql_in_host_code(spark):
    text = 'for x in xs:\n    db.execute("SELECT " + x)\ndb.query("SELECT 1")\n'
    assert rows(code.sql_in_host(spark.createDataFrame([("a.py", text)], "path string, text string"))) == [("a.py", 2, "dynamic_sql"), ("a.py", 2, "query_in_loop")]


def test_suppressions(spark):
    df = spark.createDataFrame([("// lint: allow(CRAP, nope , loc)",), ("none",)], "t string")
    assert [r[0] for r in df.select(code.suppressions(F.col("t"))).collect()] == [["loc", "crap"], None]


def test_clones_within_a_file_and_short_files(spark):
    text = " ".join("abcdefgh") + " x " + " ".join("abcdefgh")
    docs = spark.createDataFrame([(1, "en", text), (2, "en", "a b"), (3, "en", None), (4, "de", " ".join("abcdefgh"))], "f int, l string, t string")
    assert rows(code.clone_runs(code.kgrams(docs, "f", "l", "t", 4), 4)) == [(1, 0, 8), (1, 9, 17)]
    assert rows(code.clone_groups(code.kgrams(docs, "f", "l", "t", 4), 4).select("occurrences", "files", "tokens")) == [(2, 1, 8)]


def test_sinks(spark):
    f = spark.createDataFrame([("r,1", "high", "a:b.c", 0, "50%\nx|y")], "rule string, severity string, path string, line int, message string")
    assert sinks.annotations(f).first()[0] == "::error file=a%3Ab.c,line=1,title=r%2C1::50%25%0Ax|y"
    assert sinks.markdown(f.select("message")).first()[0] == "| 50%\nx\\|y |"
    log = json.loads(sinks.sarif_log(f, "t").first()[0])
    assert log["runs"][0]["results"][0]["level"] == "error"
    assert json.loads(sinks.json_rows(spark.sql("SELECT cast(null AS int) AS a")).first()[0]) == {"schema_version": 1, "a": None}
    assert "?" in spark.range(1).select(sinks.badge(F.lit(None).cast("string"))).first()[0]


def test_append_is_idempotent_and_refuses_conflicts(spark, tmp_path):
    path = f"{tmp_path}/trend"
    point = lambda f: spark.createDataFrame([("k", f, 1.0)], "key string, fingerprint string, v double")
    assert snapshots.append_points(path, point("a"), ["key"], "fingerprint") == {"added": 1}
    assert snapshots.append_points(path, point("a"), ["key"], "fingerprint") == {"unchanged": 1}
    with pytest.raises(snapshots.Conflict):
        snapshots.append_points(path, point("b"), ["key"], "fingerprint")
    assert snapshots.append_points(path, point("b"), ["key"], "fingerprint", replace=True) == {"replaced": 1}
    assert spark.read.parquet(path).select("fingerprint").first()[0] == "b"


def test_index_refresh_keeps_what_has_not_changed(spark):
    sources = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_key string")
    index = spark.createDataFrame([("a", "1", 7), ("b", "0", 8), ("gone", "3", 9)], "path string, content_key string, m int")
    todo = snapshots.to_refresh(sources, index)
    assert rows(todo) == [("b", "2")]
    assert rows(snapshots.refreshed(index, sources, todo.withColumn("m", F.lit(5)))) == [("a", "1", 7), ("b", "2", 5)]


@pytest.fixture
def folder(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.read.schema(streams.EVENTS).parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(path)
    return path


def test_streams_equal_batches(spark, folder):
    batch = spark.read.parquet(folder)
    q = streams.counters(streams.read(spark, folder, 1)).writeStream.format("memory").queryName("counters").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    expected = batch.groupBy("event_type").agg(F.count("*"), F.round(F.sum("value"), 4))
    assert rows(spark.table("counters").select("event_type", "n", F.round("total", 4))) == rows(expected)


def test_tumbling_stream(spark, folder):
    q = streams.tumbling(streams.read(spark, folder), "1 day", "60 days").writeStream.format("memory").queryName("tumbling").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == spark.read.parquet(folder).count()


def test_ring_survives_a_repeated_batch(spark, folder, tmp_path):
    path = f"{tmp_path}/ring"
    q = streams.ring(streams.read(spark, folder, 1), path, 3600, 24).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    expected = telemetry.ring(spark.read.parquet(folder), "ts", 3600, 24)
    assert rows(spark.read.parquet(f"{path}/batch=2").select("slot", "n")) == rows(expected)


def test_baselines_are_written_whole_and_checked(spark, tmp_path):
    from sedimenta.sources import baselines

    rows_ = [("a.py", "f#1", "f", 1, 3, 2, None, 0), ("a.py", "f#2", "f", 9, 4, 2, 2.5, 1)]
    schema = "path string, id string, name string, line int, cognitive int, cyclomatic int, crap double, max_nesting int"
    path = str(tmp_path / "baseline")
    baselines.write(path, spark.createDataFrame(rows_, schema).withColumn("more", F.lit(1)))
    assert rows(baselines.read(spark, path)) == rows_
    with pytest.raises(baselines.Duplicate, match="a.py f#1"):
        baselines.write(path, spark.createDataFrame([*rows_, rows_[0]], schema))
    assert rows(baselines.read(spark, path)) == rows_  # the old one stays
    baselines.write(path, spark.createDataFrame(rows_[:1], schema))
    assert rows(baselines.read(spark, path)) == rows_[:1]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["baseline"]
    spark.createDataFrame(rows_, schema).drop("id").write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="without id"):
        baselines.read(spark, str(tmp_path / "odd"))


def test_budgets_by_hand(spark):
    from sedimenta.operators import projections

    f = spark.createDataFrame([("b", "g", 5, 1, 1, None, None), ("a", "f", 9, 7, 2, 3.0, 1.0), ("a", "e", 9, 2, 2, 9.0, 0.5)], "path string, fn string, line int, cognitive int, cyclomatic int, crap double, coverage double")
    shown = lambda **x: [(r.fn, r.truncated) for r in projections.functions(f, projections.Budget(**x)).collect()]
    assert shown() == [("e", False), ("f", False), ("g", False)]
    assert shown(sort_by="crap") == [("e", False), ("f", False), ("g", False)]
    assert shown(sort_by="cognitive", top=1) == [("f", True)]
    assert shown(min_crap=3.0, top=2) == [("e", False), ("f", False)]
    with pytest.raises(ValueError):
        projections.Budget(sort_by="loc")
    side = lambda *r: spark.createDataFrame(list(r), "path string, fn string, start int, cognitive int, cyclomatic int, crap double, loc int")
    pairs = drift.paired(side(("a", "up", 1, 1, 1, 1.0, 5), ("a", "down", 2, 9, 1, None, 5), ("a", "gone", 3, 9, 9, 9.0, 9)), side(("a", "up", 1, 1, 1, 4.0, 5), ("a", "down", 2, 2, 1, None, 5), ("a", "new", 3, 99, 1, None, 1)), ["path", "fn"], ["start"])
    told = lambda **x: rows(projections.changes(pairs, projections.Budget(**x)).select("kind", "fn", "crap_delta", "max_delta", "truncated"))
    assert told() == [("improved", "down", 0.0, 7.0, False), ("regressed", "up", 3.0, 3.0, False)]
    assert told(min_delta=4.0) == [("improved", "down", 0.0, 7.0, False)]
    assert told(min_crap=0.0) == [("regressed", "up", 3.0, 3.0, False)]
    assert sorted(r.fn for r in projections.violations(pairs, {"cognitive": 50, "crap": 30.0}).collect()) == ["down", "new"]
    assert rows(projections.compact(f.where("fn = 'f'").select("fn", (F.col("crap") / 7).alias("crap")), "crap")) == [("f", 0.4)]


def test_missing_sections_are_unknown(spark):
    from sedimenta.operators import project

    files = spark.createDataFrame([("a", "go", 2), ("b", "go", None)], "path string, language string, parse_errors int")
    none = spark.createDataFrame([], "path string, id string, start int, end int, cognitive int, cyclomatic int, crap double, coverage double")
    got = project.summary(project.Project(files, none)).first()
    assert (got.files, got.parse_errors, got.functions, got.coverage_percent, got.dependency_edges, got.duplicated_lines, got.mutation_score) == (2, 2, 0, None, None, None, None)
    assert set(project.Project(files, none).sections()) == {"files", "functions"}
    assert rows(project.parse_errors_by_language(files)) == [("go", 2, 2)]
    found = spark.createDataFrame([(1, "a", 3)], "finding_id int, path string, line int")
    assert project.enriched(found, project.Project(files, none)).select("function_id", "changed", "reason").first()[:] == (None, None, "path-not-in-project")


def test_gitleaks_without_a_level_is_high(spark):
    def log(tool, **result):
        return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool}}, "results": [{"ruleId": "r", **result}]}]})

    texts = [log("Gitleaks"), log("other"), log("other", level="none"), log("gitleaks", level="note")]
    got = reports.sarif(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string"))
    assert [r.severity for r in got.orderBy("file").collect()] == ["high", "unknown", "unknown", "low"]


def test_points_in_spans_of_any_length(spark):
    import random

    random.seed(12)
    spans_ = [(k % 2, i, s, s + random.choice([0, 1, 7, 63, 64, 65, 1000, 50_000])) for i, k in enumerate([0, 1] * 40) for s in [random.randrange(-500, 3000)]]
    points = [(i % 2, i, random.randrange(-600, 4000)) for i in range(200)]
    got = spans.containing(spark.createDataFrame(points, "k int, point int, at int"), spark.createDataFrame(spans_, "k int, id int, s int, e int"), "k", "at", "s", "e", 64)
    assert sorted((r.point, r.id) for r in got.collect()) == sorted((p, i) for k, p, at in points for j, i, s, e in spans_ if k == j and s <= at <= e)


def test_families_of_findings_in_one_document(spark):
    make = lambda schema, *r: spark.createDataFrame(list(r), schema)
    given = {
        "check": make("path string, fn string, line int, reasons array<string>", ("a.py", "f", 3, ["loc", "crap"])),
        "security": make("rule string, severity string, path string, line int, message string", ("S1", "low", "a.py", 4, "m")),
        "vulnerability": make("source string, package string, version string, advisory string, severity string", ("lock", "p", "1.2", "V-1", "critical")),
        "sql": make("path string, line int, rule string, severity string", ("q.sql", 2, "large_offset", "medium")),
        "policy": make("rule string, source string, target string, severity string", ("no_up", "a", "b", "high")),
        "plan": make("query string, change string, relation string, detail string, fails boolean", ("q", "cost_increase", None, "+30.0%", True), ("q", "added_sort", None, "x", False)),
    }
    found = [sinks.findings_of(k, df) for k, df in given.items()]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    back = reports.sarif(sinks.sarif_log(every, "t").select(F.lit("log").alias("file"), F.col("json").alias("text")))
    assert sorted((r.rule, r.severity, r.path, r.start_line, r.message) for r in back.collect()) == [
        ("S1", "low", "a.py", 4, "m"), ("V-1", "high", "lock", 1, "p@1.2"), ("cost_increase", "high", "q.json", 1, "+30.0%"), ("crap", "high", "a.py", 3, "f exceeds the limit of crap"),
        ("large_offset", "medium", "q.sql", 2, "large offset"), ("loc", "high", "a.py", 3, "f exceeds the limit of loc"), ("no_up", "high", "a", 1, "a -> b"),
    ]
    with pytest.raises(ValueError):
        sinks.findings_of("other", every)


def test_many_results_of_one_sarif_run_are_read_in_little_memory():
    """Three thousand results in a heap that doesn't hold a copy of their run for each."""
    code = """
from pyspark.sql import SparkSession
from sedimenta.sources import reports, sinks
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
found = spark.range(3000).selectExpr("concat('r', id % 7) AS rule", "'high' AS severity", "concat('src/u', id, '.py') AS path", "1 AS line", "'said' AS message")
back = reports.sarif(sinks.sarif_log(found, "t").selectExpr("'log' AS file", "json AS text"))
print("results", len(back.collect()))
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1]), "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "results 3000" in out.stdout, out.stderr[-2000:]


def test_repeated_kgrams_are_those_found_twice(spark):
    """Over one bin and over many, over one batch and over several; a language or a text may be unknown."""
    draw = random.Random(4)
    texts = [(i, draw.choice(["en", "de", None]), " ".join(draw.choice("abcd") for _ in range(draw.randrange(30)))) for i in range(60)] + [(60, "en", None), (61, "en", "z y x w v u t s"), (62, "de", "z y x w v u t s"), (63, "fr", "q q q q q q q q")]
    docs = spark.createDataFrame(texts, "f long, l string, t string").repartition(3)
    every = rows(code.kgrams(docs, "f", "l", "t", 5))
    seen = {}
    for _, language, _, gram in every:
        seen[language, gram] = seen.get((language, gram), 0) + 1
    expected = [r for r in every if seen[r[1], r[3]] > 1]
    assert 0 < len(expected) < len(every)
    for size in (1 << 20, 50):
        found = code.repeated_kgrams(docs, "f", "l", "t", 5, bin_chars=size)
        assert rows(found) == expected
        assert rows(code.repeated_runs(found, 5)) == rows(code.clone_runs(code.kgrams(docs, "f", "l", "t", 5), 5))
    assert rows(code.repeated_kgrams(docs.limit(0), "f", "l", "t", 5)) == []


def test_intervals_with_unknown_ends_and_halves_equal_their_sql(spark, tmp_path):
    import duckdb

    from sedimenta.plans.catalogue import ORACLE_SQL, QUERIES

    draw = random.Random(2)
    lines = [(draw.choice([None, 3, 5, 9, 1003]), draw.randrange(4), draw.choice([None, 0.5, 1.5, 2.5, 3.0, 40.0])) for _ in range(60)]
    spark.createDataFrame(sorted(set(lines), key=repr), "l_orderkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT DISTINCT l_orderkey % 1000 AS l_orderkey, l_partkey, round_even(l_quantity, 0) AS l_quantity FROM '{tmp_path}/lineitem.parquet/*.parquet' WHERE l_orderkey IS NOT NULL AND l_quantity IS NOT NULL UNION ALL SELECT l_orderkey, l_partkey, l_quantity FROM '{tmp_path}/lineitem.parquet/*.parquet' WHERE l_orderkey IS NULL OR l_quantity IS NULL")
    assert rows(QUERIES["interval_union"](spark, str(tmp_path)).select("l_partkey", "intervals", "lines")) == sorted(con.sql(ORACLE_SQL["interval_union"]).fetchall(), key=repr)
