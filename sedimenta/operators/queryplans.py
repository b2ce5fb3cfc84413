"""Query plans as rows: flattening, facts per plan, and regressions between two sets of plans."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEEPEST = 128
NODES = "query string, node string, depth int, kind string, relation string, index_name string, cost double, plan_rows double, actual_rows double, loops double"


def flattened(reports: DataFrame) -> DataFrame:
    """A row per node (see NODES) of EXPLAIN JSON texts (file, text); query is the file's stem, node its place, like ``0.1.0``.

    A plan is a tree of unknown depth, which no column type holds, so it is walked in Python, a batch at a time.
    """

    def walk(query: str, tree: dict) -> Iterator[tuple]:
        todo = [("0", 0, tree)]
        while todo:
            place, depth, node = todo.pop()
            if depth > DEEPEST:
                raise ValueError(f"{query}: deeper than {DEEPEST}")
            number = lambda k, node=node: None if node.get(k) is None else float(node[k])
            relation = node.get("Relation Name")
            yield query, place, depth, node["Node Type"], f"{node['Schema Name']}.{relation}" if relation and node.get("Schema Name") else relation, node.get("Index Name"), number("Total Cost"), number("Plan Rows"), number("Actual Rows"), number("Actual Loops")
            todo += [(f"{place}.{i}", depth + 1, child) for i, child in reversed(list(enumerate(node.get("Plans", []))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NODES.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        for batch in batches:
            rows = [r for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in walk(file.rsplit(".", 1)[0], json.loads(text)[0]["Plan"])]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return reports.select("file", "text").mapInArrow(run, NODES)


JOINS = ("Nested Loop", "Hash Join", "Merge Join")
#: Changes in the order in which they are reported.
CHANGES = ("index_to_sequential_scan", "cost_increase", "row_growth", "estimate_error", "added_sort", "join_strategy_change")


def q_error(plan_rows: Column, actual_rows: Column) -> Column:
    """How far an estimate is off, 1 or more. Both are a loop's, so they aren't multiplied by loops.

    Unknown without either, and where just one is zero: that error has no bound.
    """
    known = plan_rows.isNotNull() & actual_rows.isNotNull()
    ratio = F.greatest(F.try_divide(plan_rows, actual_rows), F.try_divide(actual_rows, plan_rows))
    return F.when(known & (plan_rows == 0) & (actual_rows == 0), F.lit(1.0)).when(known & (plan_rows != 0) & (actual_rows != 0), ratio)


def facts(nodes: DataFrame) -> DataFrame:
    """A row per query: root cost and rows, sorts, joins by strategy, relations by scan, greatest q-error, unbounded.

    fast_scans are the relations read by an index or a bitmap, seq_only those that are only read sequentially. unbounded says whether
    an estimate or an actual count is zero and the other isn't.
    """
    kind = F.col("kind")
    root = F.col("depth") == 0
    relations = lambda which: F.coalesce(F.collect_set(F.when(which, F.col("relation"))), F.array().cast("array<string>"))
    sequential, fast = kind == "Seq Scan", kind.isin("Index Scan", "Index Only Scan") | kind.startswith("Bitmap")
    one_zero = (F.col("plan_rows") == 0) != (F.col("actual_rows") == 0)
    counted = nodes.groupBy("query").agg(
        F.max(F.when(root, F.col("cost"))).alias("cost"),
        F.max(F.when(root, F.col("plan_rows"))).alias("rows"),
        F.count(F.when(kind.isin("Sort", "Incremental Sort"), 1)).alias("sorts"),
        *(F.count(F.when(kind == j, 1)).alias(j.lower().replace(" ", "_")) for j in JOINS),
        relations(sequential).alias("_seq"), relations(fast).alias("_fast"),
        F.round(F.max(q_error(F.col("plan_rows"), F.col("actual_rows"))), 6).alias("q_error"),
        F.coalesce(F.max(one_zero), F.lit(False)).alias("unbounded"),
    )
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return counted.withColumns({"seq_only": listed(F.array_except("_seq", "_fast")), "fast_scans": listed(F.col("_fast"))}).drop("_seq", "_fast")


def regressions(before: DataFrame, after: DataFrame, cost_percent: float | None = 20.0, row_ratio: float | None = 10.0, most_q_error: float | None = 100.0) -> DataFrame:
    """(query, status, change, relation, detail, baseline, current, fails): what changed between facts, in the order of CHANGES.

    An index scan that became sequential always fails, a greater cost or more rows beyond their limits, and an estimate error beyond
    its limit in the new plan, whatever the old one's. Added sorts and other joins fail only beside a failure of cost, rows or estimate in
    their query. A limit of None switches its failures off, and for estimate errors their rows too.
    """
    b = before.select("query", *(F.col(c).alias(f"b_{c}") for c in before.columns if c != "query"), F.lit(True).alias("_b"))
    a = after.select("query", *(F.col(c).alias(f"a_{c}") for c in after.columns if c != "query"), F.lit(True).alias("_a"))
    both = b.join(a, "query", "full")
    there = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    none, never = F.lit(None).cast("double"), F.lit(False)

    def row(change: str, fails: Column, detail: Column, baseline: Column = none, current: Column = none, relation: Column | None = None) -> Column:
        relation = F.lit(None).cast("string") if relation is None else relation
        return F.struct(
            F.lit(CHANGES.index(change)).alias("rank"), F.lit(change).alias("change"), relation.alias("relation"), detail.cast("string").alias("detail"),
            baseline.cast("double").alias("baseline"), current.cast("double").alias("current"), F.coalesce(fails, never).alias("fails"),
        )

    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    beyond = lambda value, limit, unbounded: never if limit is None else unbounded | (value > limit)
    cost, rows = (F.col("b_cost"), F.col("a_cost")), (F.col("b_rows"), F.col("a_rows"))
    percent = F.try_divide((cost[1] - cost[0]) * 100, cost[0])
    ratio = F.try_divide(rows[1], rows[0])
    from_zero = F.lit("unbounded increase from zero baseline")
    found = [
        F.when(cost[1] > cost[0], row("cost_increase", beyond(percent, cost_percent, cost[0] == 0), F.when(cost[0] == 0, from_zero).otherwise(F.format_string("+%.1f%%", percent)), *cost))
        .when(cost[1] < cost[0], row("cost_increase", never, F.lit("cost decreased"), *cost)),
        F.when(
            rows[0] != rows[1],
            row("row_growth", (rows[1] > rows[0]) & beyond(ratio, row_ratio, rows[0] == 0), F.when(rows[0] == 0, F.lit("unbounded growth from zero baseline")).when(rows[1] < rows[0], F.format_string("decreased to %.2fx", ratio)).otherwise(F.format_string("%.2fx", ratio)), *rows),
        ),
        F.when(F.col("a_sorts") > F.col("b_sorts"), row("added_sort", never, F.format_string("sort nodes %d -> %d", "b_sorts", "a_sorts"), F.col("b_sorts"), F.col("a_sorts"))),
    ]
    if most_q_error is not None:
        error = F.col("a_q_error")
        found.append(F.when(F.col("a_unbounded"), row("estimate_error", F.lit(True), F.lit("unbounded estimate error"))).when(error > most_q_error, row("estimate_error", F.lit(True), F.format_string("%.1fx", error), none, error)))
    for join in JOINS:
        old, new = (F.col(f"{side}_{join.lower().replace(' ', '_')}") for side in "ba")
        found.append(F.when(old != new, row("join_strategy_change", never, F.format_string(f"{join}: %d -> %d", old, new), old, new)))
    lost = F.array_intersect(listed("b_fast_scans"), listed("a_seq_only"))
    scans = F.transform(lost, lambda r: row("index_to_sequential_scan", F.lit(True), F.lit("index scan replaced by sequential scan"), relation=r))
    every = F.when(there, F.array_sort(F.concat(scans, F.filter(F.array(*found), lambda c: c.isNotNull()))))
    named = both.select("query", "_b", "_a", every.alias("changes"))
    numeric = F.exists("changes", lambda c: c["fails"] & c["change"].isin("cost_increase", "row_growth", "estimate_error"))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").when(F.size("changes") > 0, "changed").otherwise("unchanged")
    out = named.select("query", status.alias("status"), F.coalesce(numeric, never).alias("_numeric"), F.explode_outer("changes").alias("c"))
    fails = F.col("c.fails") | (F.col("_numeric") & F.col("c.change").isin("added_sort", "join_strategy_change"))
    return out.select("query", "status", "c.change", "c.relation", "c.detail", "c.baseline", "c.current", F.coalesce(fails, never).alias("fails"))
