"""Queries on findings, gates, mutants, judgments and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M
from sedimenta.operators import security, triage
from sedimenta.plans import adapters as A
from sedimenta.plans.registry import FINDINGS, query

_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


@query(f"""WITH {FINDINGS} SELECT rule, path, array_to_string(list_sort(list_distinct(list(tool))), ',') AS reports, count(*) AS seen, arg_min(severity, tool || '~' || lpad(CAST(event_id AS VARCHAR), 20, '0')) AS severity FROM findings GROUP BY rule, path""")
def scanner_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.merged(A.findings(spark, sf_dir), ["rule", "path"], "tool", ["event_id", "severity"]).select("rule", "path", "reports", "seen", "severity")


_STATE = f"""{FINDINGS}, old AS (SELECT DISTINCT tool, rule, path FROM findings WHERE ts < TIMESTAMP '2024-01-15'),
now AS (SELECT f.*, CASE WHEN o.tool IS NULL THEN 'new' ELSE 'existing' END AS state FROM findings f LEFT JOIN old o ON f.tool = o.tool AND f.rule = o.rule AND f.path = o.path WHERE ts >= TIMESTAMP '2024-01-15')"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.findings(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp")
    return security.against_baseline(f.where(F.col("ts") >= cut), f.where(F.col("ts") < cut), ["tool", "rule", "path"])


@query(f"WITH {_STATE} SELECT event_id, tool, rule, path, severity, state FROM now WHERE state = 'new' AND {_RANK} >= 4")
def scanner_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.gate(_state(spark, sf_dir), "high", new_only=True).select("event_id", "tool", "rule", "path", "severity", "state")


@query(f"WITH {_STATE} SELECT event_id, severity, state, CAST(row_number() OVER (ORDER BY {_RANK} DESC, CASE state WHEN 'new' THEN 0 ELSE 1 END, path, tool, rule, event_id) AS INT) AS place FROM now ORDER BY place LIMIT 50")
def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty worst findings in report order."""
    order = [M.severity_rank(F.col("severity")).desc(), F.when(F.col("state") == "new", 0).otherwise(1).asc(), F.asc_nulls_last("path"), F.asc("tool"), F.asc("rule"), F.asc("event_id")]
    top = _state(spark, sf_dir).orderBy(*order).limit(50)
    return top.select("event_id", "severity", "state", F.row_number().over(Window.partitionBy().orderBy(*order)).alias("place"))


@query(f"WITH {FINDINGS} SELECT severity, count(*) AS n, min(score) AS lo, max(score) AS hi FROM findings GROUP BY 1")
def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


@query(f"""WITH {FINDINGS}, c AS (SELECT path, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in M.SEVERITIES)} FROM findings GROUP BY path)
SELECT path, CASE WHEN critical > 0 THEN 'E' WHEN high > 0 THEN 'D' WHEN medium > 0 THEN 'C' WHEN low > 0 OR info > 0 THEN 'B' WHEN unknown > 0 THEN NULL ELSE 'A' END AS rating FROM c""")
def security_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {s: F.count(F.when(F.col("severity") == s, 1)) for s in M.SEVERITIES}
    rows = A.findings(spark, sf_dir).groupBy("path").agg(*(c.alias(s) for s, c in counts.items()))
    return rows.select("path", M.security_rating({s: F.col(s) for s in M.SEVERITIES}).alias("rating"))


_IMPORTS = "imports AS (SELECT DISTINCT CAST(s_suppkey % 25 AS VARCHAR) AS package, s_name AS file FROM supplier WHERE s_suppkey % 3 = 0)"
_EVIDENCE = f"""{_STATE}, {_IMPORTS}, g AS (SELECT package, array_to_string(list_sort(list_distinct(list(file))), ',') AS files FROM imports GROUP BY 1),
v AS (SELECT event_id, severity, state, CAST(rule AS VARCHAR) AS package, CASE WHEN tool = 'purchase' THEN 'pypi' ELSE 'npm' END AS ecosystem FROM now),
e AS (SELECT event_id, severity, state, package, ecosystem, CASE WHEN ecosystem = 'npm' THEN files END AS evidence, CASE WHEN ecosystem = 'npm' THEN files IS NOT NULL END AS reachable FROM v LEFT JOIN g USING (package))"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = A.load(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select((F.col("s_suppkey") % 25).cast("string").alias("package"), F.col("s_name").alias("file"))
    v = _state(spark, sf_dir).select("event_id", "severity", "state", F.col("rule").cast("string").alias("package"), F.when(F.col("tool") == "purchase", "pypi").otherwise("npm").alias("ecosystem"))
    return security.reachable(v, imports)


@query(f"WITH {_EVIDENCE} SELECT event_id, package, ecosystem, evidence, reachable FROM e")
def changed_import_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("event_id", "package", "ecosystem", "evidence", "reachable")


@query(f"WITH {_EVIDENCE} SELECT event_id, severity, reachable FROM e WHERE state = 'new' AND {_RANK} >= 3 AND reachable IS DISTINCT FROM false")
def vulnerability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.vulnerability_gate(_evidence(spark, sf_dir), "medium").select("event_id", "severity", "reachable")


#: How tools spell a status, and what that is.
_RAW = {
    "Killed": "killed", "SURVIVED": "survived", "No_Coverage": "no_coverage", "TimedOut": "timed_out", "TIME-OUT": "timed_out", "memory_error": "error", "RunError": "error", "RuntimeError": "error",
    "Non-Viable": "compile_error", "CompileError": "compile_error", "Ignored": "ignored", "Pending": "ignored", "run error": "unknown", "other": "unknown", "": "unknown",
}


@query(f"""WITH m AS (SELECT user_id, CASE WHEN event_id % 11 > 0 THEN user_id END AS path, {list(_RAW.values())!r}[1 + event_id % {len(_RAW)}] AS status FROM events)
SELECT user_id, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in security.STATUSES)}, count(*) AS mutants, count(*) FILTER (WHERE path IS NULL) AS unresolved,
count(*) FILTER (WHERE status IN ('killed', 'timed_out', 'survived', 'no_coverage')) AS scored_mutants,
round(count(*) FILTER (WHERE status IN ('killed', 'timed_out')) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE status IN ('killed', 'timed_out', 'survived', 'no_coverage')), 0), 6) AS score FROM m GROUP BY user_id""")
def mutation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, _RAW)), (F.col("event_id") % len(_RAW)).cast("int"))
    path = F.when(F.col("event_id") % 11 > 0, F.col("user_id"))
    return security.mutation_summary(A.load(spark, sf_dir, "events").select("user_id", path.alias("path"), security.mutation_status(raw).alias("status")), "user_id")


_LABELS = ["CRITICAL", "high", "Error", "medium", "MODERATE", "warning", "low", "Note", "info", "important", ""]


@query(f"SELECT {_LABELS!r}[1 + event_id % {len(_LABELS)}] AS label, ['critical', 'high', 'high', 'medium', 'medium', 'medium', 'low', 'low', 'unknown', 'unknown', 'unknown'][1 + event_id % {len(_LABELS)}] AS severity, count(*) AS n FROM events GROUP BY ALL")
def severity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("event_id") % len(_LABELS)).cast("int"))
    return A.load(spark, sf_dir, "events").select(label.alias("label"), M.severity_of_label(label).alias("severity")).groupBy("label", "severity").agg(F.count("*").alias("n"))


_ROLES = ["critical_path", "core_domain", "adapter_or_integration", "tooling_or_script", "unclear", "invented", None]
_PRIORITY = """d AS (SELECT doc_id, n_chars, quality, ['critical_path', 'core_domain', 'adapter_or_integration', 'tooling_or_script', 'unclear', 'invented', NULL][1 + doc_id % 7] AS role,
  CASE WHEN doc_id % 5 > 0 THEN (doc_id % 4)::DOUBLE END AS inherent, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS attention, CASE WHEN doc_id % 2 > 0 THEN (doc_id % 11) / 11.0::DOUBLE END AS confidence FROM documents JOIN labels USING (doc_id)),
e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM d), p AS (SELECT *, CASE WHEN hi > lo THEN (n_chars - lo)::DOUBLE / (hi - lo) ELSE 0.5 END AS normalized FROM d, e),
q AS (SELECT *, normalized * CASE role WHEN 'critical_path' THEN 1.0::DOUBLE WHEN 'core_domain' THEN 0.9::DOUBLE WHEN 'adapter_or_integration' THEN 0.6::DOUBLE WHEN 'tooling_or_script' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END
  * (0.2::DOUBLE + 0.8::DOUBLE * (1 - coalesce(inherent, 1.5) / 3.0::DOUBLE)) * coalesce(attention, 1.0) AS priority FROM p)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(A.load(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    some = lambda every, n, over: F.when(k % every > 0, (k % n).cast("double") / over)
    judged = d.withColumns({"role": F.get(F.array(*map(F.lit, _ROLES)), (k % 7).cast("int")), "inherent": some(5, 4, 1), "attention": some(3, 10, 10), "confidence": some(2, 11, 11)})
    return triage.normalized(judged, "n_chars").withColumn("priority", triage.priority(F.col("normalized"), F.col("role"), F.col("inherent"), F.col("attention")))


@query(f"WITH {_PRIORITY} SELECT doc_id, round(normalized, 6) AS normalized, round(priority, 6) AS priority FROM q")
def trio_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", F.round("normalized", 6).alias("normalized"), F.round("priority", 6).alias("priority"))


@query(f"WITH {_PRIORITY} SELECT doc_id, CASE WHEN attention < 0.4 THEN 'accept' WHEN confidence < 0.6 THEN 'review' ELSE 'act' END AS bucket FROM q")
def triage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", triage.bucket(F.col("attention"), F.col("confidence")).alias("bucket"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT CAST(least(9, floor((l_extendedprice - lo) / ((hi - lo) / 10))) AS INT) AS bin FROM lineitem, e)
SELECT CAST(r.range AS INT) AS bin, count(b.bin) AS n FROM range(10) r LEFT JOIN b ON b.bin = r.range GROUP BY 1""")
def equal_width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.equal_width(A.load(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query(f"WITH {FINDINGS} SELECT rule, count(*) AS n, CASE max({_RANK}) WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'info' ELSE 'unknown' END AS worst FROM findings GROUP BY rule")
def worst_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.worst_by(A.findings(spark, sf_dir), "rule", M.severity_rank(F.col("severity")), "severity")


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS files FROM documents GROUP BY lang")
def loc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.load(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("files"))


@query(f"WITH {FINDINGS}, r AS (SELECT tool, event_id, score, row_number() OVER (PARTITION BY tool ORDER BY score DESC, event_id) AS rank FROM findings) SELECT tool, event_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.top_per_group(A.findings(spark, sf_dir).select("tool", "event_id", "score"), ["tool"], [F.desc("score"), F.asc("event_id")], 5)
