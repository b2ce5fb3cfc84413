"""Queries on texts as code: tokens, clones, metric folds, suppressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M
from sedimenta.functions import paths as P
from sedimenta.operators import code
from sedimenta.plans import adapters as A
from sedimenta.plans.registry import query

K = 25
_WORDS = "w AS (SELECT doc_id AS file, lang AS language, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents)"
_TOKENS = f"{_WORDS}, t AS (SELECT file, language, i AS pos, ws[i + 1] AS token FROM w, range(20000) r(i) WHERE i < len(ws))"
_GRAMS = f"{_WORDS}, g AS (SELECT file, language, i AS pos, array_to_string(ws[i + 1 : i + {K}], ' ') AS gram FROM w, range(20000) r(i) WHERE i + {K} <= len(ws))"


@query(f"WITH {_WORDS}, t AS (SELECT language, unnest(ws) AS token FROM w) SELECT language, token, count(*) AS n FROM t GROUP BY ALL")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.tokens(A.load(spark, sf_dir, "documents"), "doc_id", "lang", "text").groupBy("language", "token").agg(F.count("*").alias("n"))


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.repeated_kgrams(A.load(spark, sf_dir, "documents"), "doc_id", "lang", "text", K)


@query(f"WITH {_GRAMS}, c AS (SELECT language, gram, count(*) AS occurrences, count(DISTINCT file) AS files FROM g GROUP BY ALL HAVING count(*) > 1) SELECT language, occurrences, files, count(*) AS grams FROM c GROUP BY ALL")
def kgram_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of 25 tokens, counted by how often and in how many files they are (a run's hash is Spark's own)."""
    return code.kgram_groups(_grams(spark, sf_dir)).groupBy("language", "occurrences", "files").agg(F.count("*").alias("grams"))


@query(f"""WITH {_GRAMS}, r AS (SELECT language, gram FROM g GROUP BY ALL HAVING count(*) > 1), h AS (SELECT DISTINCT file, pos FROM g JOIN r USING (language, gram)),
i AS (SELECT file, pos, pos - row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM h) SELECT file, CAST(min(pos) AS INT) AS "start", CAST(max(pos) + {K} AS INT) AS "end" FROM i GROUP BY file, k""")
def clone_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.repeated_runs(_grams(spark, sf_dir), K)


@query(f"""WITH {_GRAMS}, r AS (SELECT language, gram FROM g GROUP BY ALL HAVING count(*) > 1), h AS (SELECT DISTINCT file, pos FROM g JOIN r USING (language, gram)),
i AS (SELECT file, pos, pos - row_number() OVER (PARTITION BY file ORDER BY pos) AS k FROM h), s AS (SELECT file, min(pos) AS a, max(pos) + {K} AS b FROM i GROUP BY file, k),
x AS (SELECT file, b - a AS tokens, array_to_string(ws[a + 1 : b], ' ') AS run FROM s JOIN w USING (file)), c AS (SELECT run, count(*) AS occurrences, count(DISTINCT file) AS files, max(tokens) AS tokens FROM x GROUP BY run HAVING count(*) > 1)
SELECT occurrences, files, CAST(tokens AS INT) AS tokens, count(*) AS groups FROM c GROUP BY ALL""")
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.repeated_groups(_grams(spark, sf_dir), K).groupBy("occurrences", "files", "tokens").agg(F.count("*").alias("groups"))


_EVENTS = """ev AS (SELECT l_orderkey AS fn, l_linenumber AS pos, CASE l_linenumber % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'operator' WHEN 2 THEN 'operand' WHEN 3 THEN 'else' ELSE 'jump' END AS kind,
CAST(l_quantity AS INT) % 4 AS nesting, l_returnflag || l_linestatus AS text FROM lineitem)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("decision", "operator", "operand", "else", "jump")))
    return A.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fn"), F.get(kinds, F.col("l_linenumber") % 5).alias("kind"), (F.col("l_quantity").cast("int") % 4).alias("nesting"), F.concat("l_returnflag", "l_linestatus").alias("text")
    )


_FOLD = f"""{_EVENTS}, m AS (SELECT fn, 1 + count(*) FILTER (WHERE kind = 'decision') AS cyclomatic, CAST(sum(CASE kind WHEN 'decision' THEN 1 + nesting WHEN 'else' THEN 1 WHEN 'jump' THEN 1 ELSE 0 END) AS BIGINT) AS cognitive, max(nesting) AS max_nesting,
count(DISTINCT CASE WHEN kind = 'operator' THEN text END) AS distinct_operators, count(*) FILTER (WHERE kind = 'operator') AS operators, count(DISTINCT CASE WHEN kind = 'operand' THEN text END) AS distinct_operands, count(*) FILTER (WHERE kind = 'operand') AS operands FROM ev GROUP BY fn)"""


@query(f"WITH {_FOLD} SELECT * FROM m")
def metric_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.metric_fold(_events(spark, sf_dir))


@query(f"""WITH {_FOLD}, v AS (SELECT fn, cyclomatic, CASE WHEN distinct_operators + distinct_operands > 0 THEN (operators + operands) * log2(distinct_operators + distinct_operands) ELSE 0 END AS volume,
CASE WHEN distinct_operands > 0 THEN distinct_operators / 2.0::DOUBLE * operands / distinct_operands ELSE 0 END AS difficulty FROM m)
SELECT fn, round(volume, 6) AS volume, round(difficulty, 6) AS difficulty, round(volume * difficulty, 6) AS effort, round(least(greatest((171 - 5.2::DOUBLE * ln(greatest(volume, 1)) - 0.23::DOUBLE * cyclomatic) * 100 / 171, 0), 100), 6) AS maintainability FROM v""")
def halstead(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = code.metric_fold(_events(spark, sf_dir))
    volume = M.halstead_volume(F.col("operators") + F.col("operands"), F.col("distinct_operators") + F.col("distinct_operands"))
    difficulty = M.halstead_difficulty(F.col("distinct_operators"), F.col("operands"), F.col("distinct_operands"))
    v = m.select("fn", "cyclomatic", volume.alias("volume"), difficulty.alias("difficulty"))
    return v.select("fn", F.round("volume", 6).alias("volume"), F.round("difficulty", 6).alias("difficulty"), F.round(F.col("volume") * F.col("difficulty"), 6).alias("effort"), F.round(M.maintainability(F.col("volume"), F.col("cyclomatic"), F.lit(1)), 6).alias("maintainability"))


@query("""WITH o AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) FILTER (WHERE event_type IS DISTINCT FROM before) AS runs FROM o GROUP BY 1""")
def logical_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("at"), "event_type")
    return code.logical_runs(events, "user_id", "day", "at", "event_type")


@query("""WITH p AS (SELECT doc_id, ['src/app.ts', 'lib/x_test.go', 'tests/unit/a.py', 'vendor/k.c', 'docs/readme.md', 'web/page.spec.tsx'][1 + doc_id % 6] AS path FROM documents)
SELECT path, CASE path WHEN 'src/app.ts' THEN 'typescript' WHEN 'lib/x_test.go' THEN 'go' WHEN 'tests/unit/a.py' THEN 'python' WHEN 'vendor/k.c' THEN 'c' WHEN 'web/page.spec.tsx' THEN 'tsx' END AS language,
path LIKE 'vendor/%' AS ignored, path IN ('lib/x_test.go', 'tests/unit/a.py', 'web/page.spec.tsx') AS test, path LIKE '%.md' OR path LIKE 'lib/%' AS excluded, count(*) AS n FROM p GROUP BY path""")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("src/app.ts", "lib/x_test.go", "tests/unit/a.py", "vendor/k.c", "docs/readme.md", "web/page.spec.tsx")))
    rows = A.load(spark, sf_dir, "documents").select(F.get(names, (F.col("doc_id") % 6).cast("int")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    path = F.col("path")
    return rows.select("path", P.language(path).alias("language"), P.ignored(path).alias("ignored"), P.is_test(path).alias("test"), P.matches(path, ("*.md", "/lib/")).alias("excluded"), "n")
