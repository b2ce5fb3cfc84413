"""Queries on a whole project: summary, enriched findings, projections within budgets, report orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M
from sedimenta.functions import paths as P
from sedimenta.operators import drift, graph, project, projections, security
from sedimenta.plans import adapters as A
from sedimenta.plans.registry import EDGES, FINDINGS, FUNCTIONS, PATHS, query

_CRAP = "CAST(cyclomatic AS DOUBLE) * cyclomatic * power(1 - coverage, 3) + cyclomatic"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    return A.load(spark, sf_dir, "part").select(part.alias("path"), F.concat(F.lit("l"), part % 5).alias("language"), F.when(part % 13 == 5, part % 3).otherwise(0).alias("parse_errors"))


def _project(spark: SparkSession, sf_dir: str) -> project.Project:
    files = _files(spark, sf_dir)
    edges = graph.stored(graph.deduplicated(A.raw_edges(spark, sf_dir)))  # three sections count them
    copies = A.load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("group_id"), F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.rint("l_quantity").cast("long")).alias("end"))
    mutants = A.load(spark, sf_dir, "events").select(F.get(F.array(*map(F.lit, security.STATUSES)), (F.col("event_id") % 8).cast("int")).alias("status"))
    return project.Project(files, A.functions(spark, sf_dir), edges, graph.cycles(edges), None, copies, edges.where("target % 5 = 0").withColumn("rule", F.lit("r")), mutants)


@query(f"""WITH RECURSIVE {FUNCTIONS}, {EDGES}, r(a, b) AS (SELECT source, target FROM edges UNION SELECT r.a, e.target FROM r JOIN edges e ON e.source = r.b),
cy AS (SELECT x.a AS node, min(x.b) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) >= 2),
i AS (SELECT l_suppkey, l_orderkey AS s, l_orderkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n), u AS (SELECT min(s) AS s, max(e) AS e FROM g GROUP BY l_suppkey, g),
m AS (SELECT event_id % 8 AS s FROM events)
SELECT (SELECT count(*) FROM part) AS files, (SELECT CAST(sum(p_partkey % 3) AS BIGINT) FROM part WHERE p_partkey % 13 = 5) AS parse_errors, (SELECT count(*) FROM functions) AS functions,
(SELECT round(count(coverage) * 100.0::DOUBLE / count(*), 6) FROM functions) AS coverage_percent, (SELECT count(*) FROM edges) AS dependency_edges, (SELECT count(DISTINCT cycle) FROM cy) AS dependency_cycles,
(SELECT count(DISTINCT l_partkey) FROM lineitem) AS duplication_groups, (SELECT CAST(sum(e - s + 1) AS BIGINT) FROM u) AS duplicated_lines, (SELECT count(*) FROM edges WHERE target % 5 = 0) AS policy_violations,
(SELECT round(count(*) FILTER (WHERE s IN (0, 1)) * 100.0::DOUBLE / count(*) FILTER (WHERE s < 4), 6) FROM m) AS mutation_score""")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.summary(_project(spark, sf_dir))


@query("SELECT 'l' || p_partkey % 5 AS language, count(*) AS files, CAST(sum(CASE WHEN p_partkey % 13 = 5 THEN p_partkey % 3 ELSE 0 END) AS BIGINT) AS parse_errors FROM part GROUP BY 1")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.parse_errors_by_language(_files(spark, sf_dir))


@query("""WITH f AS (SELECT event_id AS finding_id, CASE WHEN event_id % 17 > 0 THEN user_id END AS path, CASE WHEN event_id % 19 > 0 THEN event_id % 120 END AS line FROM events),
fns AS (SELECT DISTINCT user_id AS path, fn || user_id AS id, s, e, c FROM events, (SELECT * FROM (VALUES ('a', 0, 99, 9), ('b', 10, 39, 5), ('c', 10, 39, 4), ('d', 70, 75, 1)) v(fn, s, e, c)) WHERE user_id % 5 > 0),
risk AS (SELECT DISTINCT user_id AS path, user_id / 2.0::DOUBLE AS score, user_id % 7 AS blast_radius FROM events WHERE user_id % 10 > 0),
best AS (SELECT finding_id, id, c FROM f JOIN fns USING (path) WHERE line BETWEEN s AND e QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY e - s, id) = 1)
SELECT finding_id, path, line, id AS function_id, c AS cognitive, score AS risk_score, blast_radius, CASE WHEN path IS NOT NULL THEN path % 4 = 0 END AS changed,
CASE WHEN id IS NOT NULL THEN NULL WHEN path IS NULL THEN 'no-path' WHEN path % 5 = 0 AND path % 10 = 0 THEN 'path-not-in-project' ELSE 'no-function-at-location' END AS reason
FROM f LEFT JOIN best USING (finding_id) LEFT JOIN risk USING (path)""")
def findings_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without a path or a line, outside functions, in nested ones and in two alike."""
    events = A.load(spark, sf_dir, "events")
    e, u = F.col("event_id"), F.col("user_id")
    found = events.select(e.alias("finding_id"), F.when(e % 17 > 0, u).alias("path"), F.when(e % 19 > 0, e % 120).alias("line"))
    rows = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(s).cast("long").alias("start"), F.lit(x).cast("long").alias("end"), F.lit(c).alias("cognitive")) for n, s, x, c in (("a", 0, 99, 9), ("b", 10, 39, 5), ("c", 10, 39, 4), ("d", 70, 75, 1))))
    none = F.lit(None).cast("double")
    users = events.select("user_id").distinct()
    functions = users.where("user_id % 5 > 0").select(u.alias("path"), F.inline(rows)).select("path", F.concat("n", "path").alias("id"), "start", "end", "cognitive", F.lit(1).alias("cyclomatic"), none.alias("crap"), none.alias("coverage"))
    risk = users.where("user_id % 10 > 0").select(u.alias("path"), (u / 2.0).alias("score"), (u % 7).alias("blast_radius"))
    whole = project.Project(users.select(u.alias("path")), functions, risk=risk)
    got = project.enriched(found, whole, users.where("user_id % 4 = 0").select(u.alias("path")))
    return got.select("finding_id", "path", "line", "function_id", "cognitive", "risk_score", "blast_radius", "changed", "reason")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, an order's line of a part each; those that are alike are one."""
    f = A.functions(spark, sf_dir)
    return f.groupBy("path", "fn", "line").agg(*(F.max(c).alias(c) for c in ("loc", "cognitive", "cyclomatic", "coverage"))).withColumn("crap", F.round(M.crap(F.col("cyclomatic"), F.col("coverage")), 6))


_MEASURED = f"""{FUNCTIONS}, m0 AS (SELECT path, fn, line, max(loc) AS loc, max(cognitive) AS cognitive, max(cyclomatic) AS cyclomatic, max(coverage) AS coverage FROM functions GROUP BY ALL),
m AS (SELECT *, round({_CRAP}, 6) AS crap FROM m0)"""


@query(f"""WITH {_MEASURED}, k AS (SELECT * FROM m WHERE crap >= 5) SELECT path, fn, line, cognitive, cyclomatic, crap, coverage, (SELECT count(*) > 100 FROM k) AS truncated
FROM k ORDER BY crap DESC NULLS LAST, path, fn, line LIMIT 100""")
def agent_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred functions of a budget: unknown crap is dropped, the greatest come first."""
    return projections.functions(_measured(spark, sf_dir), projections.Budget(min_crap=5.0, sort_by="crap", top=100))


_CUT = "1998-04-01"
_SIDE = """SELECT l_partkey AS path, l_linenumber AS fn, l_orderkey AS start, CAST(l_quantity AS INT) AS loc, CAST(round(l_discount * 100) AS INT) AS cognitive, l_linenumber AS cyclomatic,
  CASE WHEN l_returnflag <> 'N' THEN round(l_linenumber * l_linenumber * power(round(l_tax * 100) / 10, 3) + l_linenumber, 6) END AS crap,
  row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey, l_extendedprice, l_shipdate) AS nth FROM lineitem WHERE l_shipdate {op} TIMESTAMP '{cut}'"""
_PAIRS = f"""b AS ({_SIDE.format(op='<', cut=_CUT)}), a AS ({_SIDE.format(op='>=', cut=_CUT)}),
p AS (SELECT path, fn, nth, b.start AS bstart, a.start AS astart, b.loc AS bl, a.loc AS al, b.cognitive AS bc, a.cognitive AS ac, b.crap AS bx, a.crap AS ax, b.start IS NOT NULL AND a.start IS NOT NULL AS on_both FROM b FULL JOIN a USING (path, fn, nth)),
d AS (SELECT path, fn, CAST(nth AS INT) AS nth, coalesce(ax, CASE WHEN astart IS NULL THEN bx END) AS crap, CASE WHEN coalesce(ac > bc, false) OR coalesce(al > bl, false) OR coalesce(ax > bx, false) THEN 'regressed'
    WHEN coalesce(ac < bc, false) OR coalesce(al < bl, false) OR coalesce(ax < bx, false) THEN 'improved' END AS kind, round(coalesce(ax - bx, 0), 6) AS crap_delta,
  round(greatest(abs(ac - bc)::DOUBLE, abs(al - bl)::DOUBLE, coalesce(abs(ax - bx), 0)), 6) AS max_delta FROM p WHERE on_both)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("fn"), F.col("l_orderkey").alias("start"), F.col("l_quantity").cast("int").alias("loc"), F.round(F.col("l_discount") * 100).cast("int").alias("cognitive"),
        F.col("l_linenumber").alias("cyclomatic"), F.when(F.col("l_returnflag") != "N", F.round(F.col("l_linenumber") * F.col("l_linenumber") * F.pow(F.round(F.col("l_tax") * 100) / 10, F.lit(3)) + F.col("l_linenumber"), 6)).alias("crap"),
        "l_suppkey", "l_extendedprice", "l_shipdate",
    )
    cut = F.lit(_CUT).cast("timestamp")
    return drift.paired(lines.where(F.col("l_shipdate") < cut), lines.where(F.col("l_shipdate") >= cut), ["path", "fn"], ["start", "l_suppkey", "l_extendedprice", "l_shipdate"])


@query(f"""WITH {_PAIRS}, k AS (SELECT * FROM d WHERE kind IS NOT NULL AND max_delta >= 20),
r AS (SELECT * FROM k WHERE kind = 'regressed' ORDER BY crap_delta DESC, path, fn, nth LIMIT 60), i AS (SELECT * FROM k WHERE kind = 'improved' ORDER BY path, fn, nth LIMIT 60), w AS (SELECT * FROM r UNION ALL SELECT * FROM i)
SELECT kind, path, fn, nth, crap_delta, max_delta, (SELECT greatest(count(*) FILTER (WHERE kind = 'regressed'), count(*) FILTER (WHERE kind = 'improved')) > 60 FROM k) AS truncated FROM w""")
def agent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty regressions and sixty improvements of twenty or more."""
    pairs = _pairs(spark, sf_dir)
    got = projections.changes(pairs, projections.Budget(min_delta=20.0, top=60))
    return got.select("kind", "path", "fn", "nth", F.round("crap_delta", 6).alias("crap_delta"), F.round("max_delta", 6).alias("max_delta"), "truncated")


@query(f"WITH {_PAIRS} SELECT path, fn, CAST(nth AS INT) AS nth, ac AS after_cognitive, ax AS after_crap FROM p WHERE astart IS NOT NULL AND (ac > 8 OR ax IS NULL OR ax > 30)")
def changed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.violations(_pairs(spark, sf_dir), {"cognitive": 8, "crap": 30.0}).select("path", "fn", "nth", "after_cognitive", "after_crap")


@query(f"WITH {_PAIRS} SELECT path, fn, CAST(nth AS INT) AS nth, CAST(row_number() OVER (ORDER BY path, coalesce(astart, bstart), fn) AS INT) AS place FROM p QUALIFY place <= 100")
def changed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred changed functions, by path and the line they have now, or had."""
    return projections.ordered(_pairs(spark, sf_dir), "changed", 100).select("path", "fn", "nth", "place")


_KNOWN = """v AS (SELECT event_id, severity, CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'existing' ELSE 'unknown' END AS state, tool AS ecosystem, 'p' || rule AS package, CASE WHEN event_id % 4 > 0 THEN '1.' || event_id % 6 END AS version, 'A' || event_id AS advisory FROM findings)"""


@query(f"""WITH {FINDINGS}, {_KNOWN} SELECT event_id, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, CASE state WHEN 'new' THEN 0 WHEN 'existing' THEN 1 ELSE 2 END,
ecosystem, package, version NULLS FIRST, advisory) AS INT) AS place FROM v QUALIFY place <= 100""")
def vulnerability_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred worst vulnerabilities in report order."""
    e = F.col("event_id")
    rows = A.findings(spark, sf_dir).select(
        e, "severity", F.when(e % 3 == 0, "new").when(e % 3 == 1, "existing").otherwise("unknown").alias("state"), F.col("tool").alias("ecosystem"), F.concat(F.lit("p"), "rule").alias("package"),
        F.when(e % 4 > 0, F.concat(F.lit("1."), e % 6)).alias("version"), F.concat(F.lit("A"), e).alias("advisory"),
    )
    return projections.ordered(rows, "vulnerabilities", 100).select("event_id", "place")


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY CASE WHEN event_id % 7 > 0 THEN user_id END NULLS FIRST, event_id % 5, event_id % 3, event_type, event_id % 2, event_id % 11, event_id) AS INT) AS place FROM events QUALIFY place <= 100""")
def mutant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred mutants in report order; those without a path come first."""
    e = F.col("event_id")
    rows = A.load(spark, sf_dir, "events").select(
        e, F.when(e % 7 > 0, F.col("user_id")).alias("path"), (e % 5).alias("start_line"), (e % 3).alias("start_column"), F.col("event_type").alias("provider"), (e % 2).alias("operator"), (e % 11).alias("status"),
        e.alias("native_id"), F.lit(None).cast("string").alias("description"),
    )
    return projections.ordered(rows, "mutants", 100).select("event_id", "place")


@query("""WITH f AS (SELECT l_orderkey % 500 AS symbol_key FROM lineitem WHERE l_orderkey % 500 < 300 AND l_linenumber = 1 AND l_orderkey < 1200)
SELECT c_custkey, c_custkey AS symbol_key, CASE (SELECT count(*) FROM f WHERE f.symbol_key = c_custkey) WHEN 0 THEN 'unknown symbol key' WHEN 1 THEN NULL ELSE 'ambiguous symbol key' END AS reason FROM customer""")
def symbol_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as relations whose keys no function has, one or several."""
    k = F.col("l_orderkey") % 500
    functions = A.load(spark, sf_dir, "lineitem").where((k < 300) & (F.col("l_linenumber") == 1) & (F.col("l_orderkey") < 1200)).select(k.alias("symbol_key"))
    return project.symbols(A.load(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("symbol_key")), functions)


@query(f"""WITH {PATHS} SELECT DISTINCT path FROM paths WHERE c_custkey % 3 <> 0 AND NOT regexp_matches(path, '(^|/)CANADA(/|$)')""")
def untracked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.paths(spark, sf_dir)
    return project.untracked(known, known.where("c_custkey % 3 = 0"), P.matches(F.col("path"), ("CANADA",)))


@query("""WITH w AS (SELECT p_partkey AS group_id, p_size, min(p_size) OVER () AS lo, max(p_size) OVER () AS hi FROM part)
SELECT group_id, round(CASE WHEN hi > lo THEN (p_size - lo)::DOUBLE / (hi - lo) ELSE 0.5 END * CASE WHEN group_id % 4 > 0 THEN (group_id % 10) / 10.0::DOUBLE ELSE 0 END, 4) AS priority FROM w""")
def duplication_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups weigh by tokens, between the least and the greatest; one that nobody judged has no priority."""
    from sedimenta.operators import triage

    k = F.col("p_partkey")
    part = A.load(spark, sf_dir, "part")
    weighed = triage.normalized(part.select(k.alias("group_id"), "p_size"), "p_size").withColumnRenamed("normalized", "weight")
    answers = part.where("p_partkey % 4 > 0").select(k.alias("group_id"), ((k % 10) / 10.0).alias("extraction"), F.lit(1.0).alias("confidence"))
    return projections.duplication_priority(weighed, answers).select("group_id", "priority")
