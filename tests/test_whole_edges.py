"""Queries over all edges against brute force, where recursive SQL is too slow; tests/test_oracles.py has the others."""

from __future__ import annotations

import os
from collections import defaultdict

import pytest

from sedimenta.plans.catalogue import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

def brute_edges(spark):
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        orders[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_extendedprice))
    return {(a[1], b[1]) for rows in orders.values() for a, b in zip(sorted(rows), sorted(rows)[1:], strict=False) if a[1] != b[1]}


def brute_search(following, start):
    distance, now = {start: 0}, [start]
    while now:
        now = [b for a in now for b in following[a] if distance.setdefault(b, distance[a] + 1) == distance[a] + 1 and b not in now]
        now = list(dict.fromkeys(now))
    return distance


@pytest.fixture(scope="module")
def edges(spark):
    return brute_edges(spark)


@pytest.fixture(scope="module")
def backward(edges):
    following = defaultdict(set)
    for a, b in edges:
        following[b].add(a)
    return following


def test_all_edges_are_there(spark, edges):
    assert {(r.source, r.target) for r in QUERIES["edge_dedupe"](spark, SF).collect()} == edges


def test_impact_over_all_edges(spark, backward):
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    newest = max(r.o_orderdate for r in orders)
    recent = {r.o_orderkey for r in orders if (newest - r.o_orderdate).total_seconds() <= 2 * 86400}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    expected = {p: brute_search(backward, p) for p in {r.l_partkey for r in lines if r.l_orderkey in recent}}
    assert expected
    assert {(r.start, r.node, r.distance) for r in QUERIES["impact_distances"](spark, SF).collect()} == {(s, n, d) for s, of in expected.items() for n, d in of.items()}
    parts = [r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    counts = {r.node: (r.direct_dependents, r.blast_radius, r.blast_radius_percent) for r in QUERIES["impact_counts"](spark, SF).collect()}
    assert counts == {p: (len(backward[p]), len(of) - 1, round((len(of) - 1) * 100 / (len(parts) - 1), 6)) for p in parts for of in [brute_search(backward, p)]}


def test_cycles_over_all_edges(spark, edges, backward):
    reach = {n: set(brute_search(backward, n)) for n in {n for e in edges for n in e}}
    expected = {}
    for n, of in reach.items():
        group = {m for m in of if n in reach[m]}
        if len(group) > 1:
            expected[n] = min(group)
    assert expected and {r.node: r.cycle for r in QUERIES["scc_cycles"](spark, SF).collect()} == expected
