"""Queries on imports: every supplier is a script that imports the next one and a package, and exports one name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import drift, imports, telemetry, triage
from sedimenta.plans import adapters as A
from sedimenta.plans.registry import FUNCTIONS, query


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.format_string('import { x%d } from "./s%d";\nimport "pkg%d/sub";\nexport const x%d = 1;\n', k + 1, k + 1, k % 5, k)
    return A.load(spark, sf_dir, "supplier").select(F.format_string("src/s%d.ts", k).alias("path"), text.alias("text"))


@query("""SELECT 'src/s' || s_suppkey || '.ts' AS path, './s' || (s_suppkey + 1) AS specifier, CASE WHEN s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) THEN 'src/s' || (s_suppkey + 1) || '.ts' END AS target,
CASE WHEN s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) THEN 'resolved' ELSE 'not_found' END AS state FROM supplier UNION ALL SELECT 'src/s' || s_suppkey || '.ts', 'pkg' || s_suppkey % 5 || '/sub', NULL, 'external' FROM supplier""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return imports.resolved(imports.extracted(files), files).select("path", "specifier", "target", "state")


@query("SELECT 'pkg' || s_suppkey % 5 AS package, count(*) AS files FROM supplier GROUP BY 1")
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.packages(imports.extracted(_files(spark, sf_dir)))


@query("SELECT 'src/s' || s_suppkey || '.ts' AS path, 'x' || s_suppkey AS name FROM supplier WHERE s_suppkey - 1 NOT IN (SELECT s_suppkey FROM supplier) AND s_suppkey <> 5")
def unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return imports.unused_exports(files, files.where("path = 'src/s5.ts'"))


@query("SELECT '.' AS directory, 'pkg' || i AS package FROM range(8) r(i) WHERE i NOT IN (SELECT s_suppkey % 5 FROM supplier)")
def unused_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.range(1).select(F.lit(".").alias("directory"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("pkg"), i.cast("string"))).alias("declared"))
    return imports.unused_dependencies(imports.extracted(_files(spark, sf_dir)), declared)


@query("""WITH o AS (SELECT l_partkey AS g, l_suppkey AS p, CAST(l_quantity AS INT) AS f, l_shipdate < TIMESTAMP '1998-04-01' AS old FROM lineitem),
b AS (SELECT DISTINCT g, p, f FROM o WHERE old), a AS (SELECT DISTINCT g, p, f FROM o WHERE NOT old),
u AS (SELECT g, p, f FROM b UNION SELECT g, p, f FROM a), s AS (SELECT g, p, f, CASE WHEN g NOT IN (SELECT g FROM b) THEN 'new' WHEN g NOT IN (SELECT g FROM a) THEN 'removed'
 WHEN (g, p, f) IN (SELECT (g, p, f) FROM b) AND (g, p, f) IN (SELECT (g, p, f) FROM a) THEN 'existing' WHEN (g, p, f) IN (SELECT (g, p, f) FROM a) THEN 'new'
 WHEN (g, f) NOT IN (SELECT (g, f) FROM a) THEN 'removed' END AS status FROM u)
SELECT g AS group_id, p AS path, f AS fingerprint, status FROM s WHERE status IS NOT NULL""")
def clone_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are clone groups, suppliers files, quantities fingerprints."""
    rows = A.load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("group_id"), F.col("l_suppkey").alias("path"), F.col("l_quantity").cast("int").alias("fingerprint"), "l_shipdate")
    cut = F.lit("1998-04-01").cast("timestamp")
    return drift.clone_drift(rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut))


@query(f"""WITH {FUNCTIONS}, r AS (SELECT 'cognitive' AS key, path, fn, CAST(cognitive AS DOUBLE) AS value, row_number() OVER (ORDER BY cognitive DESC, path, fn) AS rank FROM (SELECT path, fn, max(cognitive) AS cognitive FROM functions GROUP BY ALL)
UNION ALL SELECT 'loc', path, fn, CAST(loc AS DOUBLE), row_number() OVER (ORDER BY loc DESC, path, fn) FROM (SELECT path, fn, max(loc) AS loc FROM functions GROUP BY ALL))
SELECT key, CAST(rank AS INT) AS rank, path, fn, value FROM r WHERE rank <= 20""")
def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty worst functions by each of two metrics."""
    f = A.functions(spark, sf_dir).groupBy("path", "fn").agg(F.max("cognitive").alias("cognitive"), F.max("loc").alias("loc"))
    return triage.summary(f, ["cognitive", "loc"], 20)


@query("SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS outcome, count(*) * 2 AS n FROM events WHERE user_id % 3 <> 2 GROUP BY ALL")
def telemetry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of the same counters, added up; rows with an outcome that isn't in the closed set are dropped."""
    one = A.load(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).cast("string").alias("outcome")).agg(F.count("*").alias("n"))
    kept = telemetry.valid(one, {"outcome": ("0", "1")}, "event_type", ["outcome"])
    return telemetry.merged(kept, kept, ["event_type", "outcome"], "n")
