"""Where queries register, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) under its name; sql is None where SQL can't say it."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


#: Canonical relations as DuckDB sees them; see adapters.py for Spark's.
COMMIT_FILES = """commit_files AS (
  SELECT l_orderkey AS "commit", l_partkey AS path, CAST(sum(l_quantity) AS BIGINT) AS lines_added,
         CAST(round(sum(round(l_tax * 100))) AS BIGINT) AS lines_deleted
  FROM lineitem GROUP BY ALL)"""
COMMITS = """commits AS (SELECT o_orderkey AS "commit", o_orderdate AS ts, o_custkey AS identity FROM orders)"""
HEAD = """head AS (SELECT epoch(max(o_orderdate)) AS h FROM orders)"""
FUNCTIONS = """functions AS (
  SELECT l_partkey AS path, l_orderkey AS fn, l_linenumber AS line, CAST(l_quantity AS INT) AS loc,
         CAST(round(l_discount * 100) AS INT) AS cognitive, l_linenumber AS cyclomatic,
         CASE WHEN l_returnflag <> 'N' THEN 1 - round(l_tax * 100) / 10 END AS coverage
  FROM lineitem)"""
EDGES = """raw_edges AS (
  SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS target,
         CASE WHEN l_linenumber % 2 = 0 THEN 'import' ELSE 'call' END AS kind
  FROM lineitem),
edges AS (SELECT source, target, CASE WHEN max(CASE WHEN kind = 'import' THEN 1 ELSE 0 END) = 1 THEN 'import' ELSE 'call' END AS kind
          FROM raw_edges WHERE target IS NOT NULL AND source <> target GROUP BY source, target)"""
SEVERITY = """CASE WHEN {s} IS NULL THEN 'unknown' WHEN {s} < 4 THEN 'low' WHEN {s} < 7 THEN 'medium' WHEN {s} < 9 THEN 'high' ELSE 'critical' END"""
FINDINGS = f"""findings AS (
  SELECT event_id, event_type AS tool, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS rule, user_id AS path, ts, value, round(value / 50, 4) AS score,
         {SEVERITY.format(s="round(value / 50, 4)")} AS severity
  FROM events)"""
PATHS = """paths AS (SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ANCESTORS = """CASE k WHEN 0 THEN '.' WHEN 1 THEN split_part(path, '/', 1) ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END"""
