"""Graphs beyond one task: contraction, counts between components, and walks from many starts, against searches by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sedimenta.operators import graph, history, searches


def islands(seed, n=8, size=9, per=14):
    """Edges of n graphs without an edge between them."""
    draw = random.Random(seed)
    return {(k * size + draw.randrange(size), k * size + draw.randrange(size)) for k in range(n) for _ in range(per)}


def reach(pairs):
    following = {}
    for a, b in pairs:
        following.setdefault(a, set()).add(b)
    out = {}
    for s in {n for e in pairs for n in e}:
        distance, now = {s: 0}, [s]
        while now:
            now = list(dict.fromkeys(b for a in now for b in following.get(a, ()) if b not in distance and not distance.update({b: distance[a] + 1})))
        out[s] = distance
    return out


@pytest.mark.parametrize("seed", range(20))
def test_kernels_equal_a_search(seed):
    draw = random.Random(seed)
    n = 30
    pairs = sorted({(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randrange(60))})
    source, target = (np.array([p[i] for p in pairs], np.int32) for i in (0, 1))
    there = reach(pairs + [(i, i) for i in range(n)])
    assert searches.strong(n, source, target).tolist() == [min(b for b in there[i] if i in there[b]) for i in range(n)]
    both = reach(pairs + [(b, a) for a, b in pairs] + [(i, i) for i in range(n)])
    assert searches.weak(n, source, target).tolist() == [min(both[i]) for i in range(n)]
    walked = {s: dict(zip(nodes.tolist(), d.tolist(), strict=True)) for s, nodes, d in searches.walks(*searches.adjacency(n, source, target), np.arange(n))}
    assert walked == there


def test_many_islands_in_chunks(spark, monkeypatch):
    """A few edges a task; most_rounds of one leaves colouring no round to repeat."""
    monkeypatch.setattr(graph, "CHUNK_EDGES", 30)
    monkeypatch.setattr(graph, "WALKING_TASKS", 6)
    monkeypatch.setattr(graph, "COUNTED_EDGES", 0)
    pairs = {(a, b) for a, b in islands(3) if a != b}
    there = reach(pairs)
    edges = spark.createDataFrame(sorted(pairs), "source long, target long")
    strong = {n: sorted(m for m in of if n in there[m]) for n, of in there.items()}
    assert {r.node: r.cycle for r in graph.cycles(edges, most_rounds=1, one_task=30).collect()} == {n: s[0] for n, s in strong.items() if len(s) > 1}
    starts = spark.createDataFrame([(n,) for n in (0, 1, 20, 21, 40, 999)], "node long")
    expected = {(s, n, d) for s in (0, 1, 20, 21, 40) for n, d in there.get(s, {s: 0}).items()} | {(999, 999, 0)}
    assert sorted(map(tuple, graph.distances(edges, starts, one_task=0, most_rounds=1).collect())) == sorted(expected)
    only = starts.where("node > 20")
    assert sorted(map(tuple, graph.distances(edges, starts, one_task=0, most_rounds=1, only=only).collect())) == sorted(e for e in expected if e[1] in (21, 40, 999))
    nodes = spark.createDataFrame([(n,) for n in there], "node long")
    blast = {n: sum(n in of for of in there.values()) - 1 for n in there}
    assert {r.node: r.blast_radius for r in graph.impact_counts(edges, nodes).collect()} == blast


def test_a_long_path_needs_no_rounds(spark):
    edges = spark.range(60).selectExpr("id AS source", "id + 1 AS target")
    starts = spark.createDataFrame([(0,), (50,)], "node long")
    assert graph.distances(edges, starts, one_task=0, most_rounds=5).count() == 61 + 11


def test_counts_within_a_cycle_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "COUNTED_EDGES", 0)
    monkeypatch.setattr(graph, "distances", None)
    edges = spark.range(50).selectExpr("id AS source", "(id + 1) % 50 AS target")
    got = graph.impact_counts(edges, spark.range(51).selectExpr("id AS node")).collect()
    assert {(r.direct_dependents, r.blast_radius) for r in got if r.node < 50} == {(1, 49)} and len(got) == 51


def test_pairs_are_counted_by_as_many_tasks_as_they_need(spark, monkeypatch):
    """Pairs once went by the session's number of partitions, however many there were."""
    monkeypatch.setattr(history, "PAIRS_OF_A_TASK", 10)
    files = spark.range(120).selectExpr("id div 6 AS commit", "id % 9 AS path")
    pairs = history.coupling(files)
    plan = pairs._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(source#" in plan and ", 30)" in plan
    commits = [{i % 9 for i in range(6 * c, 6 * c + 6)} for c in range(20)]
    expected = {(a, b): n for a in range(9) for b in range(a + 1, 9) if (n := sum({a, b} <= c for c in commits)) > 1}
    assert {(r.source, r.target): r.co_changes for r in pairs.collect()} == expected


def test_selection_totals_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "distances", None)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    edges = spark.createDataFrame([("x/test_a.py", "x/a.py"), ("x/test_b.py", "x/a.py")], "source string, target string")
    got = graph.selection_totals(paths("x/a.py", "y/b.py"), paths("x/test_a.py", "x/test_b.py", "y/test_c.py", "z/test_d.py"), paths("x/a.py", "y/b.py"), edges)
    assert got.first()[:] == (4, 3, 0.75, "directory", "no test found: y/b.py")
