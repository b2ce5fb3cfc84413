"""Report formats: JSON, SARIF, CI formats, Prometheus text, tables. Each is a column or a DataFrame of lines; nothing is collected here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note", "unknown": "none"}
CLIMATE = {"critical": "blocker", "high": "critical", "medium": "major", "low": "minor", "info": "info", "unknown": "info"}


def _mapped(value: Column, names: dict[str, str]) -> Column:
    out = F.lit(next(reversed(names.values())))
    for name, label in names.items():
        out = F.when(value == name, label).otherwise(out)
    return out


def json_rows(df: DataFrame, version: int = 1) -> DataFrame:
    """(line): each row as a JSON object with its schema version, unknown values written as null."""
    return df.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), *df.columns), {"ignoreNullFields": "false"}).alias("line"))


def findings_of(family: str, rows: DataFrame) -> DataFrame:
    """(rule, severity, path, line, message) of what a report of that family says, as the sinks take it.

    check: functions over a limit (path, fn, line, reasons), one for each reason. security: scanners' findings, as they are.
    vulnerability: (source, package, version, advisory, severity). sql: (path, line, rule, severity). policy: (rule, source, target, severity).
    plan: changes of plans (query, change, relation, detail) that fail. A file as a whole is line 1.
    """
    text = lambda *c: F.concat_ws(" ", *c)
    if family == "check":
        told = rows.select("path", "fn", "line", F.explode("reasons").alias("rule"))
        return told.select("rule", F.lit("high").alias("severity"), "path", "line", text("fn", F.lit("exceeds the limit of"), "rule").alias("message"))
    if family == "security":
        return rows.select("rule", "severity", "path", "line", "message")
    if family == "vulnerability":
        return rows.select(F.col("advisory").alias("rule"), "severity", F.col("source").alias("path"), F.lit(1).alias("line"), F.concat_ws("@", "package", "version").alias("message"))
    if family == "sql":
        return rows.select("rule", "severity", "path", "line", F.replace("rule", F.lit("_"), F.lit(" ")).alias("message"))
    if family == "policy":
        return rows.select("rule", "severity", F.col("source").alias("path"), F.lit(1).alias("line"), F.concat_ws(" -> ", "source", "target").alias("message"))
    if family == "plan":
        return rows.where("fails").select(F.col("change").alias("rule"), F.lit("high").alias("severity"), F.concat("query", F.lit(".json")).alias("path"), F.lit(1).alias("line"), text("relation", "detail").alias("message"))
    raise ValueError(f"no family {family}")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule, path, line, result): SARIF result objects of findings (rule, severity, path, line, message)."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule").alias("ruleId"), _mapped(F.col("severity"), LEVELS).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.sha2(F.concat_ws("|", "rule", "path", "message"), 256).alias("primary")).alias("partialFingerprints"),
    )
    return findings.select("rule", "path", "line", F.to_json(result).alias("result"))


def sarif_log(findings: DataFrame, tool: str) -> DataFrame:
    """(json): one SARIF 2.1.0 document. All results come together, as the format is one object: for a gate's findings, not for a corpus."""
    results = sarif_results(findings).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "rule", "result"))), lambda r: r["result"]), ",").alias("all"))
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '"}},"results":['
    return results.select(F.concat(F.lit(head), "all", F.lit("]}]}")).alias("json"))


def code_climate(findings: DataFrame) -> DataFrame:
    """(line): CodeClimate issues."""
    where = F.struct(F.col("path").alias("path"), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("begin")).alias("lines"))
    issue = F.struct(F.lit("issue").alias("type"), F.col("rule").alias("check_name"), F.col("message").alias("description"), _mapped(F.col("severity"), CLIMATE).alias("severity"), F.md5(F.concat_ws("|", "rule", "path", "message")).alias("fingerprint"), where.alias("location"))
    return findings.select(F.to_json(issue).alias("line"))


def annotations(findings: DataFrame) -> DataFrame:
    """(line): workflow commands, in which %, line ends, and in properties : and , are escaped."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    prop = lambda c: F.replace(F.replace(text(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("notice")
    return findings.select(F.concat(F.lit("::"), level, F.lit(" file="), prop(F.col("path")), F.lit(",line="), F.greatest(F.col("line"), F.lit(1)).cast("string"), F.lit(",title="), prop(F.col("rule")), F.lit("::"), text(F.col("message"))).alias("line"))


def markdown(df: DataFrame) -> DataFrame:
    """(line): rows of a table; bars in values are escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def badge(grade: Column, label: str = "quality") -> Column:
    """An SVG badge of a grade A to E, grey if unknown."""
    colour = _mapped(grade, {"A": "#4c1", "B": "#97ca00", "C": "#dfb317", "D": "#fe7d37", "E": "#e05d44"})
    return F.concat(
        F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="104" height="24" role="img"><rect width="72" height="24" fill="#555"/><rect x="72" width="32" height="24" fill="'),
        F.when(grade.isNull(), "#9f9f9f").otherwise(colour), F.lit(f'"/><text x="9" y="16" fill="#fff" font-size="12">{label}</text><text x="84" y="16" fill="#fff" font-size="12">'), F.coalesce(grade, F.lit("?")), F.lit("</text></svg>"),
    )


def prometheus(samples: DataFrame) -> DataFrame:
    """(metric, line): exposition lines of samples (metric, labels map, value), label names in order; values of labels escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    inside = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return samples.select("metric", F.concat("metric", inside, F.lit(" "), F.col("value").cast("string")).alias("line"))
