"""Readers of coverage, scanner, vulnerability, mutation and plan reports.

JSON and XML are read with explicit schemas and never inferred; a report that can't be parsed, or whose version isn't
known, is an error. Files are read whole, one row each, so a report must fit in memory, and those over MOST_BYTES are
refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.metrics import severity_of_label, severity_of_score
from sedimenta.functions.paths import normalized
from sedimenta.operators.security import mutation_status

MOST_BYTES = 64 * 1024 * 1024


class Invalid(ValueError):
    """A report that can't be used."""


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every file at path; larger ones than MOST_BYTES raise when they are read."""
    raw = spark.read.format("binaryFile").load(path)
    sized = F.when(F.col("length") > MOST_BYTES, F.raise_error(F.concat(F.lit("report is too large: "), F.col("path")))).otherwise(F.decode("content", "UTF-8"))
    return raw.select(F.regexp_replace("path", r"^.*/", "").alias("file"), sized.alias("text"))


def lcov(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (path, line, hits) and branches (path, line, total, covered) of LCOV texts (file, text).

    ``SF`` holds for the lines behind it up to ``end_of_record``. Equal lines of several records are summed.
    """
    lines = reports.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "row"))
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("row").startswith("SF:"), F.substring("row", 4, 1 << 20)).when(F.col("row") == "end_of_record", "")
    filled = lines.withColumn("path", normalized(F.nullif(F.last(mark, ignorenulls=True).over(order), F.lit("")))).where("path IS NOT NULL")
    number = lambda g, pattern: F.regexp_extract("row", pattern, g).cast("long")
    da, brda = r"^DA:(\d+),(\d+)", r"^BRDA:(\d+),[^,]*,[^,]*,(-|\d+)"
    hits = filled.where(F.col("row").rlike(da)).groupBy("path", number(1, da).alias("line")).agg(F.sum(number(2, da)).alias("hits"))
    taken = F.regexp_extract("row", brda, 2)
    branches = filled.where(F.col("row").rlike(brda)).groupBy("path", number(1, brda).alias("line")).agg(F.count("*").alias("total"), F.sum((~taken.isin("-", "0")).cast("long")).alias("covered"))
    return hits, branches


def jacoco(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and branches of JaCoCo XML texts: path is package/sourcefile, hits the covered instructions."""
    schema = "package array<struct<_name: string, sourcefile: array<struct<_name: string, line: array<struct<_nr: long, _ci: long, _mb: long, _cb: long>>>>>>"
    parsed = reports.select(F.from_xml("text", schema, {"mode": "FAILFAST"}).alias("r"))
    files = parsed.select(F.explode("r.package").alias("p")).select(F.col("p._name").alias("package"), F.explode("p.sourcefile").alias("s"))
    rows = files.select(F.concat_ws("/", F.nullif("package", F.lit("")), "s._name").alias("path"), F.explode("s.line").alias("l"))
    lines = rows.groupBy("path", F.col("l._nr").alias("line")).agg(F.sum("l._ci").alias("hits"))
    branches = rows.where("l._mb + l._cb > 0").groupBy("path", F.col("l._nr").alias("line")).agg(F.sum(F.expr("l._mb + l._cb")).alias("total"), F.sum("l._cb").alias("covered"))
    return lines, branches


def cobertura(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and branches of Cobertura XML texts; branches come from ``50% (1/2)``."""
    line = "line: array<struct<_number: long, _hits: long, `_condition-coverage`: string>>"
    schema = f"packages struct<package: array<struct<classes: struct<class: array<struct<_filename: string, lines: struct<{line}>>>>>>>"
    parsed = reports.select(F.from_xml("text", schema, {"mode": "FAILFAST"}).alias("r"))
    classes = parsed.select(F.explode("r.packages.package").alias("p")).select(F.explode("p.classes.class").alias("c"))
    rows = classes.select(normalized(F.col("c._filename")).alias("path"), F.explode("c.lines.line").alias("l")).select("path", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"), F.col("l.`_condition-coverage`").alias("condition"))
    fraction = r"\((\d+)/(\d+)\)"
    part = lambda g: F.regexp_extract("condition", fraction, g).cast("long")
    lines = rows.groupBy("path", "line").agg(F.sum("hits").alias("hits"))
    branches = rows.where(F.col("condition").rlike(fraction)).groupBy("path", "line").agg(F.sum(part(2)).alias("total"), F.sum(part(1)).alias("covered"))
    return lines, branches


def xml_dialect(text: Column) -> Column:
    """``jacoco`` or ``cobertura`` by the root element; null for another."""
    root = F.regexp_extract(text, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<([A-Za-z_][\w.-]*)", 1)
    return F.when(root == "report", "jacoco").when(root == "coverage", "cobertura")


SARIF = """version string, runs array<struct<
  tool: struct<driver: struct<name: string, rules: array<struct<id: string, properties: struct<`security-severity`: string>>>>>,
  results: array<struct<ruleId: string, rule: struct<id: string>, level: string, baselineState: string, message: struct<text: string>, properties: struct<`security-severity`: string>,
    partialFingerprints: map<string, string>, fingerprints: map<string, string>,
    locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int>>>>>>>>"""


def _json(reports: DataFrame, schema: str) -> DataFrame:
    return reports.select("file", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r"))


def sarif(reports: DataFrame) -> DataFrame:
    """(file, tool, rule, level, severity, state, fingerprint, path, start_line, end_line, message) of SARIF 2.1 texts.

    Severity is the result's score, else its rule's, else by level, else unknown, but high from gitleaks, which gives neither; state
    is the file's own, unknown without one.
    """
    known = F.assert_true(F.coalesce(F.col("r.version").startswith("2.1"), F.lit(False)), "SARIF 2.1 is expected")
    runs = _json(reports, SARIF).withColumn("_known", known).where("_known IS NULL").select("file", F.explode("r.runs").alias("run"))
    # what a result needs of its run is put into it: a row that had the whole run beside it would make as many copies as results
    severities = F.col("run.tool.driver.rules")

    def told(x: Column) -> Column:
        rule = F.coalesce(x["ruleId"], x["rule"]["id"])
        own = x["properties"].getField("security-severity")
        score = F.coalesce(own, F.try_element_at(F.transform(F.filter(severities, lambda k: k["id"] == rule), lambda k: k["properties"]["security-severity"]), F.lit(1)))
        return F.struct(rule.alias("rule"), score.alias("score"), x.alias("x"))

    listed = runs.select("file", F.col("run.tool.driver.name").alias("tool"), F.transform("run.results", told).alias("_results"))
    rows = listed.select("file", "tool", F.explode("_results").alias("_told")).select("file", "tool", "_told.rule", "_told.score", "_told.x")
    score, level = F.col("score").try_cast("double"), F.col("x.level")
    by_tool = F.when(F.lower("tool") == "gitleaks", "high").otherwise("unknown")
    by_level = F.when(level == "error", "high").when(level == "warning", "medium").when(level == "note", "low").otherwise(by_tool)
    place = F.try_element_at("x.locations", F.lit(1))["physicalLocation"]
    prints = F.coalesce("x.partialFingerprints", "x.fingerprints")
    return rows.select(
        "file", "tool", "rule", level.alias("level"), F.when(score.isNotNull(), severity_of_score(score)).otherwise(by_level).alias("severity"), F.coalesce("x.baselineState", F.lit("unknown")).alias("state"),
        F.try_element_at(F.map_values(prints), F.lit(1)).alias("fingerprint"), normalized(F.regexp_replace(F.url_decode(place["artifactLocation"]["uri"]), "^file:/*", "")).alias("path"),
        place["region"]["startLine"].alias("start_line"), F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("end_line"), F.col("x.message.text").alias("message"),
    )


OSV = """results array<struct<source: struct<path: string>, packages: array<struct<package: struct<name: string, version: string, ecosystem: string>,
  vulnerabilities: array<struct<id: string, severity: array<struct<type: string, score: string>>, database_specific: struct<severity: string>,
    affected: array<struct<ranges: array<struct<events: array<struct<introduced: string, fixed: string>>>>>>>>>>>>"""


def osv(reports: DataFrame) -> DataFrame:
    """(source, ecosystem, package, version, advisory, severity, fixed) of OSV-Scanner texts; the label beats the first numeric score."""
    packages = _json(reports, OSV).select(F.explode("r.results").alias("x")).select(F.col("x.source.path").alias("source"), F.explode("x.packages").alias("p"))
    rows = packages.select("source", F.col("p.package.ecosystem").alias("ecosystem"), F.col("p.package.name").alias("package"), F.col("p.package.version").alias("version"), F.explode("p.vulnerabilities").alias("v"))
    numeric = F.try_element_at(F.filter(F.transform("v.severity", lambda s: s["score"].try_cast("double")), lambda s: s.isNotNull()), F.lit(1))
    label = F.col("v.database_specific.severity")
    events = F.flatten(F.flatten(F.transform("v.affected", lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(events, lambda e: e["fixed"]), lambda f: f.isNotNull()))), ",")
    severity = F.when(label.isNotNull(), severity_of_label(label)).otherwise(severity_of_score(numeric))
    return rows.select("source", F.lower("ecosystem").alias("ecosystem"), "package", "version", F.col("v.id").alias("advisory"), severity.alias("severity"), F.coalesce(fixed, F.lit("")).alias("fixed"))


TRIVY = """Results array<struct<Target: string, Type: string, Vulnerabilities: array<struct<VulnerabilityID: string, PkgName: string, InstalledVersion: string, FixedVersion: string, Severity: string>>>>"""


def trivy(reports: DataFrame) -> DataFrame:
    """The columns of osv() from Trivy texts."""
    rows = _json(reports, TRIVY).select(F.explode("r.Results").alias("x")).select(F.col("x.Target").alias("source"), F.lower("x.Type").alias("ecosystem"), F.explode("x.Vulnerabilities").alias("v"))
    return rows.select("source", "ecosystem", F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("version"), F.col("v.VulnerabilityID").alias("advisory"), severity_of_label(F.col("v.Severity")).alias("severity"), F.coalesce("v.FixedVersion", F.lit("")).alias("fixed"))


def pit(reports: DataFrame) -> DataFrame:
    """(path, line, mutator, status, id) of PIT XML texts."""
    schema = "mutation array<struct<_status: string, sourceFile: string, lineNumber: int, mutator: string, description: string, index: int>>"
    rows = reports.select(F.from_xml("text", schema, {"mode": "FAILFAST"}).alias("r")).select(F.explode("r.mutation").alias("m"))
    return rows.select(F.col("m.sourceFile").alias("path"), F.col("m.lineNumber").alias("line"), F.substring_index("m.mutator", ".", -1).alias("mutator"), mutation_status(F.col("m._status")).alias("status"), F.col("m.index").cast("string").alias("id"))


STRYKER = """schemaVersion string, files map<string, struct<mutants: array<struct<id: string, status: string, mutatorName: string, replacement: string, location: struct<start: struct<line: int, column: int>, end: struct<line: int, column: int>>>>>>"""


def stryker(reports: DataFrame) -> DataFrame:
    """The columns of pit() from Stryker texts of schema 1."""
    r = _json(reports, STRYKER)
    known = r.withColumn("files", F.when(F.col("r.schemaVersion").startswith("1"), F.col("r.files")))
    rows = known.select(F.explode("files").alias("path", "f")).select(normalized(F.col("path")).alias("path"), F.explode("f.mutants").alias("m"))
    return rows.select("path", F.col("m.location.start.line").alias("line"), F.col("m.mutatorName").alias("mutator"), mutation_status(F.col("m.status")).alias("status"), F.col("m.id").alias("id"))


def test_map(reports: DataFrame) -> DataFrame:
    """(test, symbol, test_path, target_path) of test maps of version 2, all by one recorder."""
    schema = "schema_version int, recorder string, recorded_at string, relationships array<struct<test_id: string, symbol_key: string, test_path: string, target_path: string>>"
    r = _json(reports, schema)
    seen = r.agg(F.countDistinct("r.recorder").alias("recorders"), F.max(F.coalesce(F.col("r.schema_version") != 2, F.lit(True))).alias("other")).first()
    if seen["recorders"] > 1 or seen["other"]:
        raise Invalid("test maps must be of version 2 and of one recorder")
    return r.select(F.explode("r.relationships").alias("x")).select(F.col("x.test_id").alias("test"), F.col("x.symbol_key").alias("symbol"), F.col("x.test_path").alias("test_path"), F.col("x.target_path").alias("target_path"))


def mailmap(lines: DataFrame) -> DataFrame:
    """(ord, old_name, old_email, new_identity) of mailmap rows (ord, row) in their four forms; the identity is the proper email."""
    pattern = r"^\s*([^<#]*?)\s*<([^>]+)>\s*(?:([^<]*?)\s*<([^>]+)>)?"
    g = lambda k: F.nullif(F.regexp_extract("row", pattern, k), F.lit(""))
    return lines.where(F.col("row").rlike(pattern) & ~F.col("row").rlike(r"^\s*#")).select("ord", g(3).alias("old_name"), F.coalesce(g(4), g(2)).alias("old_email"), F.lower(g(2)).alias("new_identity"))


def numstat(log: DataFrame) -> DataFrame:
    """(commit, author, email, ts, path, added, deleted) of ``git log --numstat`` rows (n, row) whose commits begin ``@hash|author|email|unix time``.

    Binary files have no line counts. A rename ``{old => new}`` or ``old => new`` counts for the new path.
    """
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("row").startswith("@"), F.col("row"))
    filled = log.withColumn("head", F.split(F.last(head, ignorenulls=True).over(order), r"\|"))
    pattern = r"^(-|\d+)\t(-|\d+)\t(.+)$"
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("row", pattern, 3), r"\{[^}]* => ([^}]*)\}", "$1"), r"^.* => ", "")
    count = lambda g: F.nullif(F.regexp_extract("row", pattern, g), F.lit("-")).cast("long")
    return filled.where(F.col("row").rlike(pattern)).select(
        F.substring(F.col("head")[0], 2, 64).alias("commit"), F.col("head")[1].alias("author"), F.col("head")[2].alias("email"), F.timestamp_seconds(F.col("head")[3].cast("long")).alias("ts"), F.regexp_replace(path, "//", "/").alias("path"), count(1).alias("added"), count(2).alias("deleted")
    )
