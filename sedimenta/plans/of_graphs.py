"""Queries on dependency edges, and on intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators import graph, history, spans
from sedimenta.plans import adapters as A
from sedimenta.plans.registry import EDGES, PATHS, query

_E = EDGES
_NODES = "nodes AS (SELECT source AS node FROM edges UNION SELECT target FROM edges)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.deduplicated(A.raw_edges(spark, sf_dir))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()


@query(f"WITH {_E} SELECT source, target, kind FROM edges")
def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"WITH {_E} SELECT p_partkey AS node, (SELECT count(*) FROM edges WHERE target = p_partkey) AS fan_in, (SELECT count(*) FROM edges WHERE source = p_partkey) AS fan_out FROM part")
def dependency_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.fan(A.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), _edges(spark, sf_dir))
    return out.select("node", F.col("fan_in").cast("long").alias("fan_in"), F.col("fan_out").cast("long").alias("fan_out"))


#: Files of the newest commits, which a report is asked about.
NEWEST_DAYS = 2
_NEWEST = f"newest AS (SELECT DISTINCT l_partkey AS node FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE epoch(o_orderdate) >= (SELECT max(epoch(o_orderdate)) FROM orders) - {NEWEST_DAYS} * 86400)"


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.touched(A.commits(spark, sf_dir), A.commit_files(spark, sf_dir)).where(history.within(NEWEST_DAYS)).select(F.col("path").alias("node")).distinct()


@query()
def impact_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on the files of the newest commits, and how far away it is; recursive SQL would list paths, so tests search by hand."""
    return graph.distances(_edges(spark, sf_dir), _newest(spark, sf_dir), reverse=True)


IMPACT = """closure(node, other) AS (SELECT target, source FROM edges UNION SELECT c.node, e.source FROM closure c JOIN edges e ON e.target = c.other),
blast AS (SELECT node, count(*) FILTER (WHERE other <> node) AS blast_radius FROM closure GROUP BY node),
direct AS (SELECT target AS node, count(*) AS direct_dependents FROM edges GROUP BY 1),
impact AS (SELECT p_partkey AS node, coalesce(direct_dependents, 0) AS direct_dependents, coalesce(blast_radius, 0) AS blast_radius,
  round(coalesce(blast_radius, 0) * 100.0::DOUBLE / ((SELECT count(*) FROM part) - 1), 6) AS blast_radius_percent FROM part LEFT JOIN blast ON blast.node = p_partkey LEFT JOIN direct ON direct.node = p_partkey)"""


@query(f"WITH RECURSIVE {_E}, {IMPACT} SELECT * FROM impact")
def impact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact_counts(_edges(spark, sf_dir), A.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


_REACH = "r(node) AS (SELECT node FROM nodes WHERE node % 50 = 1 UNION SELECT e.target FROM r JOIN edges e ON e.source = r.node)"


@query(f"WITH RECURSIVE {_E}, {_NODES}, {_REACH} SELECT node FROM r")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.reached(edges, _nodes(edges).where("node % 50 = 1"))


@query(f"WITH RECURSIVE {_E}, {_NODES}, {_REACH} SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM r)")
def unused_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = _nodes(edges)
    return graph.unused(nodes, edges, nodes.where("node % 50 = 1"))


@query(f"""WITH RECURSIVE {_E}, r(a, b) AS (SELECT source, target FROM edges UNION SELECT r.a, e.target FROM r JOIN edges e ON e.source = r.b)
SELECT x.a AS node, min(x.b) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) >= 2""")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_edges(spark, sf_dir))


#: Parts as paths: seven directories and the root; some are tests, documents, of no known language, or not in the graph.
_FILES = """files AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 'd' || p_partkey % 7 || '/' END || CASE WHEN p_partkey % 10 = 3 THEN 'test_' ELSE 'f' END || p_partkey
  || CASE WHEN p_partkey % 17 = 0 THEN '.md' WHEN p_partkey % 19 = 0 THEN '.odd' ELSE '.py' END AS path FROM part)"""
ALWAYS_RUN = ("d5/f*1.py",)
_SELECTION = f"""{_E}, {_FILES}, {_NEWEST}, named AS (SELECT path AS test, node FROM files WHERE node % 10 = 3),
changed AS (SELECT node, path, CASE WHEN regexp_matches(path, '^d5/f[^/]*1[.]py$') THEN 'always run' WHEN path LIKE '%.md' THEN 'documentation' WHEN path LIKE '%.odd' THEN 'unsupported extension'
  WHEN node % 13 = 5 THEN 'parse error' WHEN node % 29 = 0 THEN 'not in graph' ELSE 'seed' END AS why FROM newest JOIN files USING (node)),
declared AS (SELECT node, path AS test FROM files WHERE node % 10 = 3 OR node % 31 = 7 AND node % 29 <> 0),
r(start, node) AS (SELECT node, node FROM changed WHERE why = 'seed' UNION SELECT r.start, e.source FROM r JOIN edges e ON e.target = r.node),
reach AS (SELECT test, f.path AS via, start FROM r JOIN declared USING (node) JOIN files f ON f.node = start),
stuck AS (SELECT path, why FROM changed WHERE why NOT IN ('always run', 'documentation', 'seed') UNION ALL SELECT path, 'no test found' FROM changed WHERE why = 'seed' AND node NOT IN (SELECT start FROM reach)),
every AS (SELECT test, 0 AS tier, via FROM reach UNION ALL SELECT test, 1, path FROM stuck, named WHERE path NOT LIKE '%/%' OR split_part(test, '/', 1) = split_part(path, '/', 1) AND test LIKE '%/%'
  UNION ALL SELECT test, 2, path FROM changed, named WHERE why = 'always run'),
reasons AS (SELECT why || ': ' || path AS reason, 1 AS tier FROM stuck UNION ALL SELECT why || ': ' || path, 2 FROM changed WHERE why = 'always run')"""


def _selection(spark: SparkSession, sf_dir: str) -> tuple:
    part = F.col("p_partkey")
    name = F.concat(F.when(part % 97 == 0, "").otherwise(F.concat(F.lit("d"), part % 7, F.lit("/"))), F.when(part % 10 == 3, "test_").otherwise("f"), part, F.when(part % 17 == 0, ".md").when(part % 19 == 0, ".odd").otherwise(".py"))
    files = A.load(spark, sf_dir, "part").select(part.alias("node"), name.alias("path"))
    of = lambda side: files.select(F.col("node").alias(f"_{side}"), F.col("path").alias(f"{side}_path"))
    edges = _edges(spark, sf_dir).join(of("source"), F.col("source") == F.col("_source")).join(of("target"), F.col("target") == F.col("_target")).select(F.col("source_path").alias("source"), F.col("target_path").alias("target"))
    known = files.where("node % 29 <> 0").select("path", (F.col("node") % 13 == 5).alias("parse_error"), (F.col("node") % 31 == 7).alias("declares_tests"))
    return _newest(spark, sf_dir).join(files, "node").select("path"), files.where("node % 10 = 3").select("path"), known, edges, ALWAYS_RUN


@query(f"WITH RECURSIVE {_SELECTION} SELECT test, ['graph', 'directory', 'all'][1 + max(tier)] AS tier, array_to_string(list_sort(list_distinct(list(via))), ',') AS via FROM every GROUP BY test")
def test_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.select_tests(*_selection(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SELECTION}, s AS (SELECT count(DISTINCT test) AS selected FROM every), t AS (SELECT count(*) AS test_files FROM (SELECT test FROM named UNION SELECT test FROM every))
SELECT test_files, selected, round(CASE WHEN test_files = 0 THEN 0 ELSE selected::DOUBLE / test_files END, 6) AS ratio, (SELECT ['graph', 'directory', 'all'][1 + max(tier)] FROM reasons) AS escalation,
(SELECT coalesce(array_to_string(list_sort(list_distinct(list(reason))), ';'), '') FROM reasons) AS reasons FROM s, t""")
def selection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.selection_totals(*_selection(spark, sf_dir))


_SPANS = """l AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) AS dt FROM events),
s AS (SELECT g, user_id, t, sum(CASE WHEN dt > g * 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY g, user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM l, (SELECT unnest([1, 6, 24]) AS g)),
spans AS (SELECT user_id, g || ':' || user_id || ':' || min(t) AS id, min(t) AS "start", max(t) AS "end" FROM s GROUP BY g, user_id, n)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.load(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("t"))
    out = None
    for hours in (1, 6, 24):
        order = Window.partitionBy("user_id").orderBy("t")
        apart = F.coalesce(F.col("t") - F.lag("t").over(order) > hours * 3600, F.lit(False))
        runs = events.withColumn("_new", apart.cast("int")).withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        found = runs.groupBy("user_id", "_n").agg(F.min("t").alias("start"), F.max("t").alias("end")).select("user_id", F.concat_ws(":", F.lit(str(hours)), "user_id", "start").alias("id"), "start", "end")
        out = found if out is None else out.unionAll(found)
    return out


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.load(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("t"))
    return spans.containing(points, _spans(spark, sf_dir), "user_id", "t", "start", "end", 6 * 3600)


@query(f"""WITH {_SPANS}, p AS (SELECT event_id, id, "end" - "start" AS size FROM events e JOIN spans s ON e.user_id = s.user_id AND CAST(floor(epoch(ts)) AS BIGINT) BETWEEN "start" AND "end")
SELECT event_id, id FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY size, id) = 1""")
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.innermost(_contained(spark, sf_dir), ["event_id"], "start", "end", "id").select("event_id", "id")


@query(f"""WITH {_SPANS}, p AS (SELECT event_id, id, "end" - "start" AS size FROM events e JOIN spans s ON e.user_id = s.user_id AND CAST(floor(epoch(ts)) AS BIGINT) BETWEEN "start" AND "end"),
q AS (SELECT event_id, id FROM p QUALIFY rank() OVER (PARTITION BY event_id ORDER BY size) = 1)
SELECT event_id, CASE WHEN count(*) = 1 THEN min(id) END AS id, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM q GROUP BY 1""")
def ambiguous_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.unique_innermost(_contained(spark, sf_dir), ["event_id"], "start", "end", "id")


_LINES = """lines AS (SELECT user_id AS path, event_id % 100 AS line, CAST(sum(CAST(floor(value) AS BIGINT) % 3) AS BIGINT) AS hits FROM events GROUP BY ALL)"""
_FNS = """fns AS (SELECT DISTINCT user_id AS path, fn, s AS "start", e AS "end" FROM events, (SELECT * FROM (VALUES ('a', 0, 9), ('b', 10, 39), ('c', 40, 99)) v(fn, s, e)))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.load(spark, sf_dir, "events").select(F.col("user_id").alias("path"), (F.col("event_id") % 100).alias("line"), (F.floor("value") % 3).alias("hits"), "event_id")
    halves = [events.where(F.col("event_id") % 2 == k).drop("event_id") for k in (0, 1)]
    return spans.merged_lines(*halves)


def _fns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(n).alias("fn"), F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end")) for n, s, e in (("a", 0, 9), ("b", 10, 39), ("c", 40, 99))))
    return A.load(spark, sf_dir, "events").select(F.col("user_id").alias("path")).distinct().select("path", F.inline(rows))


@query(f"WITH {_LINES} SELECT * FROM lines")
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query(f"""WITH {_LINES}, {_FNS}, c AS (SELECT path, fn, sum(1 + CASE WHEN line % 4 = 0 THEN 2 ELSE 0 END) AS known, sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END + CASE WHEN line % 4 = 0 THEN least(hits, 2) ELSE 0 END) AS covered
FROM lines JOIN fns USING (path) WHERE line BETWEEN "start" AND "end" GROUP BY ALL)
SELECT path, fn, CAST(coalesce(known, 0) AS BIGINT) AS known, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(CAST(covered AS DOUBLE) / known, 6) AS ratio FROM fns LEFT JOIN c USING (path, fn)""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.col("line") % 4 == 0
    lines = _lines(spark, sf_dir).withColumns({"branches": F.when(four, F.lit(2)), "branches_covered": F.when(four, F.least("hits", F.lit(2)))})
    return spans.coverage_ratio(lines, _fns(spark, sf_dir))


@query(f"""WITH {_LINES}, {_FNS}, u AS (SELECT path, fn, count(DISTINCT line) AS n_uncovered, array_to_string(list_sort(list_distinct(list(line))), ',') AS uncovered FROM lines JOIN fns USING (path) WHERE hits = 0 AND line BETWEEN "start" AND "end" GROUP BY ALL)
SELECT path, fn, CASE WHEN path % 3 > 0 THEN path * 1.5::DOUBLE END AS crap, coalesce(n_uncovered, 0) AS n_uncovered, uncovered FROM fns LEFT JOIN u USING (path, fn)""")
def test_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fns = _fns(spark, sf_dir).withColumn("crap", F.when(F.col("path") % 3 > 0, F.col("path") * 1.5))
    return spans.test_targets(fns, _lines(spark, sf_dir))


@query("""WITH i AS (SELECT l_partkey, l_orderkey % 1000 AS s, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n), u AS (SELECT l_partkey, min(s) AS s, max(e) AS e FROM g GROUP BY l_partkey, g)
SELECT l_partkey, count(*) AS intervals, CAST(sum(e - s + 1) AS BIGINT) AS lines FROM u GROUP BY 1""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = A.load(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") % 1000).alias("s"), (F.col("l_orderkey") % 1000 + F.rint("l_quantity").cast("long")).alias("e"))
    return spans.interval_union(i, "l_partkey", "s", "e").groupBy("l_partkey").agg(F.count("*").alias("intervals"), F.sum(F.col("e") - F.col("s") + 1).alias("lines"))


@query(f"""WITH {PATHS}, r AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN path WHEN 1 THEN split_part(path, '/', 2) || '/' || split_part(path, '/', 3) ELSE split_part(path, '/', 3) || 'x' END AS reported FROM paths)
SELECT reported, coalesce((SELECT max(path) FROM paths WHERE path = reported), CASE WHEN (SELECT count(DISTINCT path) FROM paths WHERE path = reported OR path LIKE '%/' || reported) = 1 THEN (SELECT min(path) FROM paths WHERE path LIKE '%/' || reported) END) AS path FROM r""")
def suffix_unique_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.paths(spark, sf_dir)
    part = lambda n: F.element_at(F.split("path", "/"), n)
    reported = known.select(F.when(F.col("c_custkey") % 3 == 0, F.col("path")).when(F.col("c_custkey") % 3 == 1, F.concat_ws("/", part(2), part(3))).otherwise(F.concat(part(3), F.lit("x"))).alias("reported")).distinct()
    return spans.by_suffix(reported, known.select("path"))


@query("""SELECT n_name AS name, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(n_regionkey || '/' || s_suppkey % 40 || '/' || n_name) END AS path, CASE count(DISTINCT s_suppkey % 40) WHEN 0 THEN 'unknown' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""".replace("CASE WHEN count(DISTINCT s_suppkey) = 1", "CASE WHEN count(DISTINCT s_suppkey % 40) = 1"))
def basename_unique_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = A.load(spark, sf_dir, "nation"), A.load(spark, sf_dir, "supplier")
    known = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_regionkey", F.col("s_suppkey") % 40, "n_name").alias("path"))
    return spans.by_basename(nation.select(F.col("n_name").alias("name")), known)


@query(f"""WITH {PATHS}, d AS (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS directory FROM paths WHERE c_custkey % 7 = 0 OR c_custkey = 5)
SELECT path, (SELECT arg_max(directory, length(directory)) FROM d WHERE path LIKE directory || '/%') AS directory FROM (SELECT DISTINCT path FROM paths)""")
def nearest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.paths(spark, sf_dir)
    part = lambda n: F.element_at(F.split("path", "/"), n)
    some = known.where("c_custkey % 7 = 0 OR c_custkey = 5")
    directories = some.select(F.when(F.col("c_custkey") % 7 == 0, F.concat_ws("/", part(1), part(2))).otherwise(part(1)).alias("directory")).distinct()
    return spans.nearest_ancestor(known.select("path").distinct(), directories)
