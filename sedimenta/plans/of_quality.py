"""Queries on thresholds and on two states: reasons, effort, ratings, gates, pairing, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M
from sedimenta.operators import drift, gates, graph
from sedimenta.plans import adapters as A
from sedimenta.plans.registry import EDGES, FINDINGS, FUNCTIONS, query

LIMITS = {"cognitive": 7, "cyclomatic": 5, "loc": 45, "crap": 30.0}
EFFORT_LIMITS = {"cognitive": 7, "cyclomatic": 5, "crap": 30.0}
_CRAP = "CAST(cyclomatic AS DOUBLE) * cyclomatic * power(1 - coverage, 3) + cyclomatic"
_F = f"{FUNCTIONS}, g AS (SELECT *, {_CRAP} AS crap FROM functions)"
_REASONS = """list_filter([CASE WHEN cognitive > 7 THEN 'cognitive' END, CASE WHEN cyclomatic > 5 THEN 'cyclomatic' END, CASE WHEN loc > 45 THEN 'loc' END,
  CASE WHEN crap IS NULL THEN 'crap_unavailable' WHEN crap > 30 THEN 'crap' END], lambda x: x IS NOT NULL)"""


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.functions(spark, sf_dir)
    return f.withColumn("crap", M.crap(F.col("cyclomatic"), F.col("coverage")))


@query(f"WITH {_F} SELECT path, fn, line, loc, round(crap, 6) AS crap, count(*) AS n FROM g GROUP BY ALL")
def crap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(spark, sf_dir).select("path", "fn", "line", "loc", F.round("crap", 6).alias("crap")).groupBy("path", "fn", "line", "loc", "crap").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, r AS (SELECT {_REASONS} AS reasons FROM g) SELECT array_to_string(reasons, ',') AS reasons, count(*) AS functions FROM r GROUP BY 1")
def threshold_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(spark, sf_dir).groupBy(F.array_join(M.violation_reasons(LIMITS), ",").alias("reasons")).agg(F.count("*").alias("functions"))


@query(f"""WITH {_F}, r AS (SELECT {_REASONS} AS reasons, CASE fn % 3 WHEN 0 THEN ['cognitive'] WHEN 1 THEN ['crap', 'loc'] ELSE NULL END AS hidden FROM g),
u AS (SELECT reasons, list_filter(reasons, lambda x: NOT coalesce(list_contains(CASE WHEN list_contains(hidden, 'crap') THEN list_append(hidden, 'crap_unavailable') ELSE hidden END, x), false)) AS left_ FROM r)
SELECT array_to_string(left_, ',') AS reasons, count(*) AS functions, CAST(sum(len(reasons) - len(left_)) AS BIGINT) AS suppressed FROM u GROUP BY 1""")
def suppression_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.when(F.col("fn") % 3 == 0, F.array(F.lit("cognitive"))).when(F.col("fn") % 3 == 1, F.array(F.lit("crap"), F.lit("loc")))
    reasons = M.violation_reasons(LIMITS)
    rows = _functions(spark, sf_dir).select(reasons.alias("all"), hidden.alias("hidden")).select("all", M.unsuppressed(F.col("all"), F.col("hidden")).alias("left"))
    return rows.groupBy(F.array_join("left", ",").alias("reasons")).agg(F.count("*").alias("functions"), F.sum(F.size("all") - F.size("left")).alias("suppressed"))


_EFFORT = """e AS (SELECT path, loc, CAST(8 * greatest(cognitive - 7, 0) AS BIGINT) AS cognitive, CAST(4 * greatest(cyclomatic - 5, 0) AS BIGINT) AS cyclomatic,
  CASE WHEN crap IS NULL THEN 0 ELSE CAST(ceil(12 * greatest(crap - 30, 0)) AS BIGINT) END AS crap FROM g)"""


@query(f"WITH {_F}, {_EFFORT} SELECT path, CAST(sum(cognitive) AS BIGINT) AS cognitive, CAST(sum(cyclomatic) AS BIGINT) AS cyclomatic, CAST(sum(crap) AS BIGINT) AS crap, CAST(sum(cognitive + cyclomatic + crap) AS BIGINT) AS minutes FROM e GROUP BY path")
def gate_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.effort(EFFORT_LIMITS)
    rows = _functions(spark, sf_dir).select("path", *(c.alias(n) for n, c in e.items()))
    return rows.groupBy("path").agg(*(F.sum(n).alias(n) for n in e), F.sum(F.col("cognitive") + F.col("cyclomatic") + F.col("crap")).alias("minutes"))


@query(f"""WITH {_F}, {_EFFORT}, m AS (SELECT path, sum(cognitive + cyclomatic + crap) AS minutes, sum(loc) AS loc FROM e GROUP BY path)
SELECT path, CASE WHEN loc = 0 OR minutes / (loc * 30.0::DOUBLE) <= .05 THEN 'A' WHEN minutes / (loc * 30.0::DOUBLE) <= .1 THEN 'B' WHEN minutes / (loc * 30.0::DOUBLE) <= .2 THEN 'C'
  WHEN minutes / (loc * 30.0::DOUBLE) <= .5 THEN 'D' ELSE 'E' END AS rating FROM m""")
def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.effort(EFFORT_LIMITS)
    total = e["cognitive"] + e["cyclomatic"] + e["crap"]
    m = _functions(spark, sf_dir).groupBy("path").agg(F.sum(total).alias("minutes"), F.sum("loc").alias("loc"))
    return m.select("path", M.maintainability_rating(F.col("minutes"), F.col("loc")).alias("rating"))


@query(f"""WITH {_F}, {_EFFORT}, {FINDINGS}, s AS (SELECT CAST(sum(cognitive + cyclomatic + crap) AS BIGINT) AS minutes, sum(loc) AS loc FROM e),
w AS (SELECT max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 0 END) AS worst, count(*) AS n FROM findings),
v AS (SELECT minutes, CASE WHEN minutes / (loc * 30.0::DOUBLE) <= .05 THEN 'A' WHEN minutes / (loc * 30.0::DOUBLE) <= .1 THEN 'B' WHEN minutes / (loc * 30.0::DOUBLE) <= .2 THEN 'C' WHEN minutes / (loc * 30.0::DOUBLE) <= .5 THEN 'D' ELSE 'E' END AS m,
  CASE WHEN n = 0 THEN 'A' ELSE CASE worst WHEN 5 THEN 'E' WHEN 4 THEN 'D' WHEN 3 THEN 'C' WHEN 2 THEN 'B' END END AS s FROM s, w),
c AS (SELECT 'maintainability_rating' AS metric, 'C' AS threshold, m AS actual, m <= 'C' AS passed FROM v UNION ALL SELECT 'security_rating', 'D', s, s <= 'D' FROM v UNION ALL SELECT 'effort_minutes', '1000', CAST(minutes AS VARCHAR), minutes <= 1000 FROM v)
SELECT metric, threshold, actual, coalesce(passed, false) AS passed, (SELECT bool_and(coalesce(passed, false)) FROM c) AS gate FROM c""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.quality_gate(_functions(spark, sf_dir), EFFORT_LIMITS, {"maintainability_rating": "C", "security_rating": "D", "effort_minutes": 1000}, A.findings(spark, sf_dir))


CUT = "1998-04-01"
_SIDES = f"""b AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nth FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'),
a AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nth FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}')"""
_KEYS = ["o_custkey", "o_orderpriority"]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = A.load(spark, sf_dir, "orders").select(*_KEYS, "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    return orders.where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp")), orders.where(F.col("o_orderdate") >= F.lit(CUT).cast("timestamp"))


def _pairs(spark: SparkSession, sf_dir: str, how: str = "full") -> DataFrame:
    return drift.paired(*_sides(spark, sf_dir), _KEYS, ["o_orderdate", "o_orderkey"], how)


@query(f"""WITH {_SIDES} SELECT o_custkey, o_orderpriority, CAST(nth AS INT) AS nth, b.o_totalprice AS before_o_totalprice, a.o_totalprice AS after_o_totalprice,
CASE WHEN b.o_totalprice IS NULL OR a.o_totalprice IS NULL THEN NULL WHEN a.o_totalprice > b.o_totalprice THEN 'regressed' WHEN a.o_totalprice < b.o_totalprice THEN 'improved' ELSE 'unchanged' END AS direction
FROM b FULL JOIN a USING (o_custkey, o_orderpriority, nth)""")
def pair_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(*_KEYS, "nth", "before_o_totalprice", "after_o_totalprice", drift.direction(["o_totalprice"]).alias("direction"))


@query(f"WITH {_SIDES} SELECT o_custkey, o_orderpriority, CAST(nth AS INT) AS nth, b.o_orderstatus AS before_o_orderstatus, a.o_orderstatus AS after_o_orderstatus FROM b FULL JOIN a USING (o_custkey, o_orderpriority, nth) WHERE b.o_orderstatus IS DISTINCT FROM a.o_orderstatus")
def pair_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changed(_pairs(spark, sf_dir), "o_orderstatus").select(*_KEYS, "nth", "before_o_orderstatus", "after_o_orderstatus")


@query(f"WITH {_SIDES} SELECT o_custkey, o_orderpriority, CAST(nth AS INT) AS nth, round(a.o_totalprice - b.o_totalprice, 4) AS delta FROM b JOIN a USING (o_custkey, o_orderpriority, nth) WHERE a.o_totalprice - b.o_totalprice > 100000")
def baseline_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir, "inner").where(drift.regressed("o_totalprice", 100_000))
    return pairs.select(*_KEYS, "nth", F.round(F.col("after_o_totalprice") - F.col("before_o_totalprice"), 4).alias("delta"))


@query(f"""WITH {_SIDES}, p AS (SELECT o_custkey, o_orderpriority, nth, b.o_custkey AS hb, a.o_custkey AS ha, CASE WHEN b.o_orderstatus <> 'P' THEN b.o_totalprice END AS bp, CASE WHEN a.o_orderstatus <> 'P' THEN a.o_totalprice END AS ap FROM b FULL JOIN a USING (o_custkey, o_orderpriority, nth)),
d AS (SELECT *, unnest(['price', 'half']) AS dimension, unnest([bp, bp / 2]) AS before, unnest([ap, ap / 2]) AS after, unnest([400000, 100000]) AS lim FROM p),
t AS (SELECT *, CASE WHEN hb IS NULL THEN false ELSE before > lim END AS was, CASE WHEN ha IS NULL THEN false ELSE after > lim END AS now FROM d)
SELECT dimension, CASE WHEN was IS NULL OR now IS NULL THEN 'unknown' WHEN NOT was AND now THEN 'new' WHEN was AND now THEN 'existing' ELSE 'resolved' END AS transition, count(*) AS n, CAST(sum(CAST(coalesce(after, 0) AS DECIMAL(18, 3))) AS DOUBLE) AS after
FROM t WHERE was IS NULL OR now IS NULL OR was OR now GROUP BY 1, 2""")
def debt_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    sides = [s.withColumns({"price": price, "half": price / 2}) for s in _sides(spark, sf_dir)]
    found = drift.transitions(drift.paired(*sides, _KEYS, ["o_orderdate", "o_orderkey"]), _KEYS, {"price": 400_000, "half": 100_000})
    return found.groupBy("dimension", "transition").agg(F.count("*").alias("n"), F.sum(F.coalesce("after", F.lit(0.0)).cast("decimal(18,3)")).cast("double").alias("after"))


@query(f"""WITH b AS (SELECT CASE WHEN o_custkey = 7 THEN 8 ELSE o_custkey END AS path, o_orderdate, o_custkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' AND o_custkey <> 8),
bs AS (SELECT path, max(o_totalprice) / 5000 AS before FROM b GROUP BY path), s AS (SELECT o_custkey AS path, max(o_totalprice) / 5000 AS after FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}' GROUP BY 1)
SELECT path, before, after, round(coalesce(after, 0) - coalesce(before, 0), 6) AS delta,
CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN after > before THEN 'increased' WHEN after < before THEN 'decreased' ELSE 'unchanged' END AS change FROM bs FULL JOIN s USING (path)""")
def risk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = _sides(spark, sf_dir)
    score = lambda df: df.groupBy(F.col("o_custkey").alias("path")).agg((F.max("o_totalprice") / 5000).alias("score"))
    renames = spark.createDataFrame([(7, 8)], "old long, new long")
    return drift.risk_changes(score(b.where("o_custkey <> 8")), score(a), renames)


RULES = [("no_fives", r".*", r"5$", "high"), ("no_up", r"^1", r"^2", "low"), ("no_self_decade", r"^(\d)\d$", r"^9\d$", "info")]
_VIOLATIONS = """v AS (SELECT 'no_fives' AS rule, 'high' AS severity, source, target FROM {e} WHERE target % 10 = 5 UNION ALL SELECT 'no_up', 'low', source, target FROM {e} WHERE CAST(source AS VARCHAR) LIKE '1%' AND CAST(target AS VARCHAR) LIKE '2%'
 UNION ALL SELECT 'no_self_decade', 'info', source, target FROM {e} WHERE source BETWEEN 10 AND 99 AND target BETWEEN 90 AND 99)"""


@query(f"WITH {EDGES}, {_VIOLATIONS.format(e='edges')} SELECT * FROM v")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.policy_violations(graph.deduplicated(A.raw_edges(spark, sf_dir)), RULES)


_DRIFT = f"""{EDGES}, eb AS (SELECT * FROM edges WHERE (source + target) % 3 <> 0), ea AS (SELECT * FROM edges WHERE (source + target) % 3 <> 1),
{_VIOLATIONS.format(e='eb').replace('v AS', 'vb AS')}, {_VIOLATIONS.format(e='ea').replace('v AS', 'va AS')},
d AS (SELECT rule, source, target, CASE WHEN b.rule IS NULL THEN 'new' WHEN a.rule IS NULL THEN 'resolved' ELSE 'existing' END AS status FROM (SELECT rule, source, target FROM vb) b FULL JOIN (SELECT rule, source, target FROM va) a USING (rule, source, target))"""


@query(f"WITH {_DRIFT} SELECT * FROM d")
def policy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.deduplicated(A.raw_edges(spark, sf_dir))
    before, after = (drift.policy_violations(edges.where((F.col("source") + F.col("target")) % 3 != k), RULES) for k in (0, 1))
    return drift.keyed_drift(before, after, ["rule", "source", "target"])


@query(f"WITH {EDGES}, {_VIOLATIONS.format(e='edges')} SELECT source, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info, CASE max(CASE severity WHEN 'high' THEN 4 WHEN 'low' THEN 2 ELSE 1 END) WHEN 4 THEN 'high' WHEN 2 THEN 'low' ELSE 'info' END AS worst FROM v GROUP BY source")
def policy_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = drift.policy_violations(graph.deduplicated(A.raw_edges(spark, sf_dir)), RULES)
    return v.groupBy("source").agg(*(F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("high", "low", "info")), F.max_by("severity", M.severity_rank(F.col("severity"))).alias("worst"))



@query("SELECT l_partkey, l_linenumber, CAST(l_quantity AS INT) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-04-01' EXCEPT ALL SELECT l_partkey, l_linenumber, CAST(l_quantity AS INT) FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-04-01'")
def causes_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there after more often than before."""
    rows = A.load(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"), "l_shipdate")
    cut = F.lit(CUT).cast("timestamp")
    return rows.where(F.col("l_shipdate") >= cut).drop("l_shipdate").exceptAll(rows.where(F.col("l_shipdate") < cut).drop("l_shipdate"))


@query("""WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')
SELECT 'union' AS op, k FROM (SELECT k FROM b UNION SELECT k FROM a) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM b INTERSECT SELECT k FROM a) UNION ALL SELECT 'except', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.load(spark, sf_dir, "orders")
    b = orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select(F.col("o_custkey").alias("k")).distinct()
    a = orders.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).select(F.col("o_custkey").alias("k")).distinct()
    named = lambda name, df: df.select(F.lit(name).alias("op"), "k")
    return named("union", b.union(a).distinct()).unionAll(named("intersect", b.intersect(a))).unionAll(named("except", b.subtract(a)))
