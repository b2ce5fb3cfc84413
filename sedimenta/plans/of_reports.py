"""Queries on report formats: readers and writers over tables shaped like reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import code, queryplans, security
from sedimenta.plans import adapters as A
from sedimenta.plans.registry import FINDINGS, query
from sedimenta.sources import reports, sinks


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.findings(spark, sf_dir)
    return f.select(F.concat(F.lit("r"), "rule").alias("rule"), "severity", F.concat(F.lit("src/u"), "path", F.lit(".py")).alias("path"), (F.col("event_id") % 100).cast("int").alias("line"), F.concat("tool", F.lit(": 5%")).alias("message"))


@query(f"""WITH {FINDINGS} SELECT '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END || ' file=src/u' || path || '.py,line=' || greatest(event_id % 100, 1) || ',title=r' || rule || '::' || tool || '%3A 5%25' AS line FROM findings""".replace("%3A", ":"))
def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.annotations(_findings(spark, sf_dir))


@query()
def sarif_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif_results(_findings(spark, sf_dir))


@query()
def sarif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's findings written as one SARIF document and read again."""
    gate = _findings(spark, sf_dir).where("severity IN ('critical', 'high')")
    return reports.sarif(sinks.sarif_log(gate, "sedimenta").select(F.lit("log.sarif").alias("file"), F.col("json").alias("text"))).select("tool", "rule", "severity", "path", "start_line", "message")


@query()
def codeclimate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.code_climate(_findings(spark, sf_dir))


@query("""SELECT 'events_total{type="' || event_type || '",user="' || user_id || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id""")
def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = A.load(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("value"))
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    return sinks.prometheus(counted.select(F.lit("events_total").alias("metric"), labels.alias("labels"), "value")).select("line")


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown(A.load(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("""WITH e AS (SELECT user_id, event_id % 50 AS line, count(*) AS hits FROM events GROUP BY ALL) SELECT 'src/u' || user_id || '.c' AS path, line, hits FROM e""")
def lcov_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is an LCOV record whose lines are hit once by each event; two records are in one report."""
    rows = A.load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda e: F.concat(F.lit("DA:"), (e % 50).cast("string"), F.lit(",1"))), "\n").alias("body"))
    texts = rows.select(F.concat(F.lit("r"), "user_id").alias("file"), F.concat(F.lit("TN:\nSF:./src/x/../u"), "user_id", F.lit(".c\n"), "body", F.lit("\nend_of_record\n")).alias("text"))
    return reports.lcov(texts)[0]


#: The plans of both sides as DuckDB sees them, by order: see _plans.
_PLANS = """o AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS price FROM orders),
b AS (SELECT k, CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE ELSE price END AS cost, CASE WHEN k % 13 = 0 THEN 0 ELSE k % 50 + 1 END AS "rows", CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS sorts, CASE k % 4 WHEN 0 THEN 'Nested Loop' ELSE 'Hash Join' END AS join_kind,
  CASE k % 5 WHEN 0 THEN 'Seq Scan' WHEN 1 THEN 'Index Scan' WHEN 2 THEN 'Index Only Scan' WHEN 3 THEN 'Bitmap Heap Scan' ELSE 'CTE Scan' END AS scan, k % 3 AS estimated, k % 4 * 40 AS actual FROM o WHERE k % 9 <> 1),
a AS (SELECT k, CASE k % 3 WHEN 0 THEN price * 1.5 WHEN 1 THEN price ELSE price / 2 END AS cost, CASE k % 7 WHEN 0 THEN 600 ELSE k % 50 + 1 END AS "rows", CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS sorts, 'Hash Join' AS join_kind,
  CASE k % 3 WHEN 0 THEN 'Seq Scan' ELSE 'Index Scan' END AS scan, k % 3 AS estimated, k % 4 * 40 AS actual FROM o WHERE k % 9 <> 2)"""
_RATIO = "CASE WHEN estimated = 0 AND actual = 0 THEN 1.0::DOUBLE WHEN estimated > 0 AND actual > 0 THEN greatest(actual::DOUBLE / estimated, estimated::DOUBLE / actual) END"


def _plans(spark: SparkSession, sf_dir: str, after: bool = False) -> DataFrame:
    """EXPLAIN documents, one per order: a sort or a limit over a join over a scan, whose kinds and numbers go by the key."""
    k = F.col("o_orderkey")
    price = F.round("o_totalprice", 2)
    if after:
        cost, rows, top, join = F.when(k % 3 == 0, price * 1.5).when(k % 3 == 1, price).otherwise(price / 2), F.when(k % 7 == 0, 600).otherwise(k % 50 + 1), k % 2 == 0, F.lit("Hash Join")
        scan = F.when(k % 3 == 0, "Seq Scan").otherwise("Index Scan")
    else:
        cost, rows, top, join = F.when(k % 11 == 0, 0.0).otherwise(price), F.when(k % 13 == 0, 0).otherwise(k % 50 + 1), k % 3 == 0, F.when(k % 4 == 0, "Nested Loop").otherwise("Hash Join")
        scan = F.get(F.array(*map(F.lit, ("Seq Scan", "Index Scan", "Index Only Scan", "Bitmap Heap Scan", "CTE Scan"))), (k % 5).cast("int"))
    node = lambda **x: F.struct(*(v.alias(n.replace("_", " ")) for n, v in x.items()))
    leaf = node(Node_Type=scan, Relation_Name=F.lit("orders"), Schema_Name=F.lit("public"), Plan_Rows=k % 3, Actual_Rows=k % 4 * 40, Actual_Loops=F.lit(9))
    root = node(Node_Type=F.when(top, "Sort").otherwise("Limit"), Total_Cost=cost, Plan_Rows=rows, Plans=F.array(node(Node_Type=join, Plans=F.array(leaf))))
    return A.load(spark, sf_dir, "orders").select(k, F.concat(k.cast("string"), F.lit(".json")).alias("file"), F.to_json(F.array(F.struct(root.alias("Plan")))).alias("text"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(queryplans.facts(queryplans.flattened(_plans(spark, sf_dir, after).where(F.col("o_orderkey") % 9 != gone))) for after, gone in ((False, 1), (True, 2)))


@query(f"""WITH {_PLANS} SELECT CAST(k AS VARCHAR) AS query, cost, CAST("rows" AS DOUBLE) AS "rows", CAST(sorts AS BIGINT) AS sorts, CAST(join_kind = 'Nested Loop' AS BIGINT) AS nested_loop, CAST(join_kind = 'Hash Join' AS BIGINT) AS hash_join, 0::BIGINT AS merge_join,
round({_RATIO}, 6) AS q_error, (estimated = 0) <> (actual = 0) AS unbounded, CASE WHEN scan = 'Seq Scan' THEN 'public.orders' ELSE '' END AS seq_only, CASE WHEN scan IN ('Index Scan', 'Index Only Scan', 'Bitmap Heap Scan') THEN 'public.orders' ELSE '' END AS fast_scans FROM b""")
def plan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[0]


@query(f"""WITH {_PLANS}, p AS (SELECT k, b.cost AS bc, a.cost AS ac, b."rows" AS br, a."rows" AS ar, b.sorts AS bs, a.sorts AS "as", b.join_kind AS bj, b.scan AS bscan, a.scan AS ascan, a.estimated, a.actual FROM b JOIN a USING (k)),
c AS (SELECT k, 0 AS rank, 'index_to_sequential_scan' AS change, true AS fails, false AS numeric FROM p WHERE bscan IN ('Index Scan', 'Index Only Scan', 'Bitmap Heap Scan') AND ascan = 'Seq Scan'
  UNION ALL SELECT k, 1, 'cost_increase', ac > bc AND (bc = 0 OR (ac - bc) * 100 / bc > 20), true FROM p WHERE ac <> bc
  UNION ALL SELECT k, 2, 'row_growth', ar > br AND (br = 0 OR ar::DOUBLE / br > 10), true FROM p WHERE ar <> br
  UNION ALL SELECT k, 3, 'estimate_error', true, true FROM p WHERE (estimated = 0) <> (actual = 0) OR {_RATIO} > 50
  UNION ALL SELECT k, 4, 'added_sort', false, false FROM p WHERE "as" > bs
  UNION ALL SELECT k, 5, 'join_strategy_change', false, false FROM p, (SELECT unnest(['Hash Join', 'Nested Loop'])) WHERE bj <> 'Hash Join'),
n AS (SELECT k, bool_or(fails AND numeric) AS numeric FROM c GROUP BY k)
SELECT CAST(k AS VARCHAR) AS query, CASE WHEN change IS NULL THEN 'unchanged' ELSE 'changed' END AS status, change, coalesce(fails OR (n.numeric AND rank >= 4), false) AS fails FROM p LEFT JOIN c USING (k) LEFT JOIN n USING (k)
UNION ALL SELECT CAST(k AS VARCHAR), 'new', NULL, false FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT CAST(k AS VARCHAR), 'removed', NULL, false FROM b WHERE k NOT IN (SELECT k FROM a)""")
def plan_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs, rows, scans and joins that grow, shrink, come from zero or stay; some plans are only on one side."""
    return queryplans.regressions(*_sides(spark, sf_dir), most_q_error=50.0).select("query", "status", "change", "fails")


@query("""SELECT 'q' || o_orderkey || '.sql' AS path, CASE o_orderkey % 4 WHEN 0 THEN 1 ELSE 2 END AS line, CASE o_orderkey % 4 WHEN 0 THEN 'update_without_where' WHEN 1 THEN 'leading_wildcard' WHEN 2 THEN 'large_offset' ELSE 'non_sargable_predicate' END AS rule,
CASE o_orderkey % 4 WHEN 0 THEN 'high' ELSE 'medium' END AS severity FROM orders""")
def sql_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.sql_findings(_sql(spark, sf_dir))


@query("SELECT 'q' || o_orderkey || '.sql' AS path, 1 AS line, 'update_without_where' AS rule FROM orders WHERE o_orderkey % 4 = 0")
def sql_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that a gate at high severity stops."""
    return security.gate(code.sql_findings(_sql(spark, sf_dir)), "high").select("path", "line", "rule")


def _sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*map(F.lit, (
        "UPDATE t SET a = ';where'; -- where\nDELETE FROM t WHERE a = 1;",
        "-- a comment; with a semicolon\nSELECT a FROM t WHERE b LIKE '%x';\nSELECT 'offset 2000' FROM t",
        "SELECT a FROM t OFFSET 1000;\nSELECT a FROM t OFFSET 1001",
        "CREATE TABLE t (a int);\nSELECT * FROM t JOIN u ON true WHERE lower(a) = 'b'",
    )))
    return A.load(spark, sf_dir, "orders").select(F.concat(F.lit("q"), "o_orderkey", F.lit(".sql")).alias("path"), F.get(texts, (F.col("o_orderkey") % 4).cast("int")).alias("text"))


@query("SELECT 'q' || o_orderkey || '.sql' AS path, 2 AS line, 'u' AS \"table\" FROM orders WHERE o_orderkey % 4 = 3")
def unknown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.unknown_tables(_sql(spark, sf_dir))
