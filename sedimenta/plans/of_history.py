"""Queries on the commit stream: hotspots, facts, ownership, coupling, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M
from sedimenta.operators import graph, history, risk
from sedimenta.operators.hotspots import hotspots as hotspot_report
from sedimenta.plans import adapters as A
from sedimenta.plans.of_graphs import IMPACT
from sedimenta.plans.registry import ANCESTORS, COMMIT_FILES, COMMITS, EDGES, FUNCTIONS, HEAD, PATHS, query


@query(f"""
WITH {COMMIT_FILES}, {HEAD}, {FUNCTIONS},
ch AS (SELECT path, count(*) FILTER (WHERE h - epoch(o_orderdate) <= 365 * 86400) AS changes
       FROM commit_files JOIN orders ON o_orderkey = "commit", head GROUP BY path),
f AS (SELECT path, max(cognitive) AS max_cognitive, max(cyclomatic) AS max_cyclomatic, count(*) AS functions,
        round(sum(CASE WHEN coverage IS NOT NULL THEN greatest(loc, 1) * coverage END) / sum(CASE WHEN coverage IS NOT NULL THEN greatest(loc, 1) END), 6) AS coverage
      FROM functions GROUP BY 1)
SELECT path, max_cognitive, max_cyclomatic, functions, coverage, changes, CAST(max_cognitive AS BIGINT) * changes AS score, (SELECT count(*) > 50 FROM f) AS truncated
FROM f LEFT JOIN ch USING (path)
ORDER BY coalesce(CAST(max_cognitive AS BIGINT) * changes, 0) DESC, max_cognitive DESC, max_cyclomatic DESC, path LIMIT 50
""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspot_report(A.functions(spark, sf_dir), A.commits(spark, sf_dir), A.commit_files(spark, sf_dir))


@query(f"""
WITH {COMMIT_FILES}, {COMMITS}, {HEAD}
SELECT path, count(*) AS commits,
  count(*) FILTER (WHERE h - epoch(ts) <= 30 * 86400) AS changes_30d, count(*) FILTER (WHERE h - epoch(ts) <= 90 * 86400) AS changes_90d,
  count(*) FILTER (WHERE h - epoch(ts) <= 365 * 86400) AS changes_365d,
  CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted,
  CAST(min(epoch(ts)) AS BIGINT) AS first_ts, CAST(max(epoch(ts)) AS BIGINT) AS last_ts, count(DISTINCT identity) AS contributors,
  count(DISTINCT CASE WHEN h - epoch(ts) <= 90 * 86400 THEN identity END) AS recent_contributors
FROM commit_files JOIN commits USING ("commit"), head GROUP BY path
""")
def history_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.facts(A.commits(spark, sf_dir), A.commit_files(spark, sf_dir))


@query(f"""
WITH {COMMIT_FILES}, {COMMITS}, {HEAD}, w AS (SELECT unnest([30, 90, 365]) AS window_days)
SELECT window_days, count(DISTINCT "commit") AS commits, count(DISTINCT path) AS files, count(*) AS touches
FROM commit_files JOIN commits USING ("commit"), head, w WHERE h - epoch(ts) <= window_days * 86400 GROUP BY 1
""")
def recency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recency(A.commits(spark, sf_dir), A.commit_files(spark, sf_dir))


_CONCENTRATION = """
r AS (SELECT {key}, identity, touches, sum(touches) OVER (PARTITION BY {key}) AS total, row_number() OVER w AS rank,
             sum(touches) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far FROM t WINDOW w AS (PARTITION BY {key} ORDER BY touches DESC, identity))
SELECT {key}, count(*) AS authors, CAST(max(total) AS BIGINT) AS touches, min(CASE WHEN rank = 1 THEN identity END) AS top_author,
       round(CAST(max(touches) AS DOUBLE) / max(total) * 100, 6) AS top_share, CAST(min(CASE WHEN 2 * so_far >= total THEN rank END) AS INT) AS bus_factor
FROM r GROUP BY {key}"""


@query(f"""WITH {COMMITS}, t AS (SELECT path, identity, count(*) AS touches FROM (SELECT DISTINCT l_orderkey AS "commit", l_partkey AS path FROM lineitem) JOIN commits USING ("commit") GROUP BY ALL),
{_CONCENTRATION.format(key="path").replace("\nSELECT path, count(*) AS authors", ",\no AS (SELECT path, count(*) AS authors")})
SELECT p_partkey AS path, coalesce(authors, 0) AS authors, coalesce(touches, 0) AS touches, top_author, top_share, bus_factor FROM part LEFT JOIN o ON path = p_partkey""")
def ownership_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no order has are files that nobody touched."""
    return history.concentration(history.touches(A.commits(spark, sf_dir), A.commit_files(spark, sf_dir)), "path", A.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("path")))


@query(f"""WITH {PATHS}, p AS (SELECT path, o_orderpriority AS identity, count(*) AS n FROM orders JOIN paths ON o_custkey = c_custkey GROUP BY ALL),
t AS (SELECT {ANCESTORS} AS module, identity, CAST(sum(n) AS BIGINT) AS touches FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL),
{_CONCENTRATION.format(key="module")}""")
def ownership_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.load(spark, sf_dir, "orders").join(A.paths(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return history.concentration(history.module_touches(orders.groupBy("path", F.col("o_orderpriority").alias("identity")).agg(F.count("*").alias("touches"))), "module")


@query(f"""WITH {PATHS}, f AS (SELECT path, count(*) AS functions, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS loc, max(o_totalprice) AS top FROM orders JOIN paths ON o_custkey = c_custkey GROUP BY path)
SELECT {ANCESTORS} AS module, count(*) AS files, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(loc) AS BIGINT) AS loc, max(top) AS top
FROM f, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1""")
def module_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.load(spark, sf_dir, "orders").join(A.paths(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    files = orders.groupBy("path").agg(F.count("*").alias("functions"), F.sum(F.floor("o_totalprice")).alias("loc"), F.max("o_totalprice").alias("top"))
    return history.rolled_up(files, F.count("*").alias("files"), F.sum("functions").alias("functions"), F.sum("loc").alias("loc"), F.max("top").alias("top"))


_PAIRS = """f AS (SELECT DISTINCT l_orderkey AS "commit", l_partkey AS path FROM lineitem),
n AS (SELECT "commit", count(*) AS n FROM f GROUP BY 1 HAVING count(*) <= 50),
t AS (SELECT path, count(*) AS changes FROM f GROUP BY 1)"""


@query(f"""WITH {_PAIRS},
p AS (SELECT a.path AS source, b.path AS target, count(*) AS co_changes FROM f a JOIN n USING ("commit") JOIN f b USING ("commit") WHERE a.path < b.path GROUP BY ALL HAVING count(*) >= 2)
SELECT source, target, co_changes, s.changes AS source_changes, t.changes AS target_changes, round(co_changes::DOUBLE / s.changes, 6) AS forward,
       round(co_changes::DOUBLE / t.changes, 6) AS backward, round(co_changes::DOUBLE / (s.changes + t.changes - co_changes), 6) AS jaccard
FROM p JOIN t s ON s.path = source JOIN t ON t.path = target""")
def coupling_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.coupling(A.commit_files(spark, sf_dir))


@query(f"""WITH {_PAIRS}, own AS (SELECT "commit" FROM f WHERE path = 1),
c AS (SELECT path, count(*) AS co_changes FROM f JOIN own USING ("commit") JOIN n USING ("commit") WHERE path <> 1 GROUP BY 1 HAVING count(*) >= 2)
SELECT path, co_changes, changes, (SELECT count(*) FROM own) AS target_changes, round(co_changes::DOUBLE / (SELECT count(*) FROM own), 6) AS directional
FROM c JOIN t USING (path) ORDER BY directional DESC, co_changes DESC, path LIMIT 20""")
def coupling_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.coupled_with(A.commit_files(spark, sf_dir), 1)


_RISK = f"""{COMMIT_FILES}, {HEAD}, {FUNCTIONS}, {EDGES}, {IMPACT},
fi AS (SELECT path, max(cognitive) AS cog, max(cyclomatic) AS cyc, max(CAST(cyclomatic AS DOUBLE) * cyclomatic * power(1 - coverage, 3) + cyclomatic) AS crap FROM functions GROUP BY path),
ch AS (SELECT path, count(*) FILTER (WHERE h - epoch(o_orderdate) <= 90 * 86400) AS changes FROM commit_files JOIN orders ON o_orderkey = "commit", head GROUP BY path),
ow AS (SELECT path, round(max(n)::DOUBLE / sum(n) * 100, 6) AS share FROM (SELECT path, o_custkey, count(*) AS n FROM commit_files JOIN orders ON o_orderkey = "commit" GROUP BY ALL) GROUP BY path),
po AS (SELECT source AS path, max(CASE WHEN target % 7 = 0 THEN 100.0::DOUBLE WHEN target % 7 = 1 THEN 60 ELSE 30 END) AS policy FROM edges WHERE target % 5 = 0 GROUP BY 1),
c AS (SELECT fi.path, 100 * greatest(least(cog / 30.0::DOUBLE, 1), least(cyc / 20.0::DOUBLE, 1)) AS complexity, 100 * least(crap / 30.0::DOUBLE, 1) AS crap, 100 * least(changes / 20.0::DOUBLE, 1) AS churn,
        least(coalesce(blast_radius_percent, 0), 100) AS impact, share AS ownership, coalesce(policy, 0) AS policy
      FROM fi LEFT JOIN ch USING (path) LEFT JOIN impact ON node = path LEFT JOIN ow USING (path) LEFT JOIN po USING (path)),
s AS (SELECT *, complexity * 20 + coalesce(crap * 15, 0) + coalesce(churn * 20, 0) + impact * 20 + coalesce(ownership * 10, 0) + policy * 15 AS weighted,
        20 + 20 + 15 + CASE WHEN crap IS NULL THEN 0 ELSE 15 END + CASE WHEN churn IS NULL THEN 0 ELSE 20 END + CASE WHEN ownership IS NULL THEN 0 ELSE 10 END AS weights FROM c),
risk AS (SELECT path, round(weighted / weights, 4) AS score, round(complexity, 6) AS complexity, round(crap, 6) AS crap, round(churn, 6) AS churn, round(impact, 6) AS impact, round(ownership, 6) AS ownership, round(policy, 6) AS policy FROM s)"""


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = A.functions(spark, sf_dir)
    files = functions.groupBy("path").agg(F.max("cognitive").alias("cognitive"), F.max("cyclomatic").alias("cyclomatic"), F.max(M.crap(F.col("cyclomatic"), F.col("coverage"))).alias("crap"))
    commits, touched = A.commits(spark, sf_dir), A.commit_files(spark, sf_dir)
    changes = history.touched(commits, touched).groupBy("path").agg(F.count(F.when(history.within(90), 1)).alias("changes"))
    owners = history.concentration(history.touches(commits, touched)).select("path", F.col("top_share").alias("concentration"))
    edges = graph.deduplicated(A.raw_edges(spark, sf_dir))
    impact = graph.impact_counts(edges, A.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))).select(F.col("node").alias("path"), "blast_radius_percent")
    level = F.when(F.col("target") % 7 == 0, "error").when(F.col("target") % 7 == 1, "warning").otherwise("info")
    violations = edges.where("target % 5 = 0").select(F.col("source").alias("path"), level.alias("severity"))
    return risk.rows(files, changes, impact, owners, violations)


@query(f"WITH RECURSIVE {_RISK} SELECT * FROM risk")
def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six components by file; what isn't known drops out of the weights."""
    return _risk(spark, sf_dir)


@query(f"WITH RECURSIVE {_RISK} SELECT path, score, CAST(row_number() OVER (ORDER BY score DESC, path) AS INT) AS place FROM risk ORDER BY place LIMIT 50")
def risk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty files of the greatest risk, in the report's order."""
    return risk.ranked(_risk(spark, sf_dir), 50).select("path", "score", "place")


@query(f"""WITH {COMMITS} , p AS (SELECT unnest(['BUILDING', 'MACHINERY']) AS seg),
m AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN 'team-special' WHEN c_mktsegment = 'BUILDING' THEN 'team-building' WHEN c_mktsegment = 'MACHINERY' THEN 'team-machine' ELSE lower(c_mktsegment) END AS identity FROM customer)
SELECT identity, count(*) AS commits FROM commits JOIN m ON commits.identity = c_custkey GROUP BY m.identity""".replace("SELECT identity, count(*)", "SELECT m.identity, count(*)").replace(", p AS (SELECT unnest(['BUILDING', 'MACHINERY']) AS seg)", ""))
def mailmap_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's segment is the email, the nation the name; a rule with a name beats one without, then the first wins."""
    people = A.load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("email"), F.col("c_nationkey").cast("string").alias("author"))
    commits = A.load(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("commit"), "email", "author")
    rules = spark.createDataFrame(
        [(1, None, "Building", "team-building"), (2, "3", "building", "team-special"), (3, None, "MACHINERY", "team-machine"), (4, None, "machinery", "late")], "ord int, old_name string, old_email string, new_identity string"
    )
    return history.resolved_identities(commits, rules).groupBy("identity").agg(F.count("*").alias("commits"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey, l_partkey AS path, l_shipdate AS ts FROM lineitem),
a AS (SELECT *, CASE WHEN path = 10 AND ts <= TIMESTAMP '1996-01-01' THEN 20 ELSE path END AS p1 FROM t),
b AS (SELECT *, CASE WHEN p1 = 20 AND (ts <= TIMESTAMP '1998-01-01') THEN 30 ELSE p1 END AS p2 FROM a)
SELECT p2 AS "current", count(*) AS n FROM b GROUP BY 1""")
def rename_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 became 20 in 1996, and 20 became 30 in 1998: older rows follow both."""
    rows = A.load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("ts")).distinct()
    moves = spark.sql("SELECT * FROM VALUES (10L, 20L, TIMESTAMP '1996-01-01'), (20L, 30L, TIMESTAMP '1998-01-01') AS t(old, new, ts)")
    return graph.renamed(moves, rows).groupBy("current").agg(F.count("*").alias("n"))
