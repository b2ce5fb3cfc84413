"""Source trees, diffs, manifests and configuration as tables."""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import paths as P

MOST_BYTES = 64 * 1024 * 1024


def discover(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), pattern: str = "*") -> DataFrame:
    """(path, size, content) of files under root that no excluded glob and no ignored folder holds, of known languages or of a pattern.

    Paths are relative to root and use slashes.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    plain = F.regexp_replace(F.col("path"), r"^[a-z]+:/*(?=/)", "")
    rows = files.select(F.regexp_replace(plain, "^" + _quoted(base) + "/", "").alias("path"), F.col("length").alias("size"), "content")
    kept = rows.where(~P.ignored(F.col("path")) & ~P.matches(F.col("path"), exclude) & (F.col("size") <= MOST_BYTES))
    return kept.where(P.language(F.col("path")).isNotNull()) if pattern == "*" else kept


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def snapshot(files: DataFrame, snapshot_id: str) -> DataFrame:
    """(snapshot_id, path, content_key, text) of discover()'s rows; content is compared by its digest."""
    return files.select(F.lit(snapshot_id).alias("snapshot_id"), "path", F.sha2("content", 256).alias("content_key"), F.decode("content", "UTF-8").alias("text"))


def name_status(rows: DataFrame) -> DataFrame:
    """(status, old, new) of ``diff --name-status`` rows (row): old is null for added files, new for deleted ones."""
    part = F.split("row", "\t")
    status = F.substring(part[0], 1, 1)
    two = status.isin("R", "C")
    return rows.where(F.col("row") != "").select(
        status.alias("status"),
        F.when(status != "A", part[1]).alias("old"),
        F.when(two, F.get(part, F.lit(2))).when(status != "D", part[1]).alias("new"),
    )


def in_scope(df: DataFrame, column: str, scope: str) -> DataFrame:
    """Rows whose path is below scope, with the path relative to it; ``.`` is everything."""
    if scope in ("", "."):
        return df
    prefix = scope.rstrip("/") + "/"
    return df.where(F.col(column).startswith(prefix)).withColumn(column, F.substring(column, len(prefix) + 1, 1 << 20))


MANIFEST = "name string, main string, module string, types string, bin string, exports string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"


def manifests(files: DataFrame) -> DataFrame:
    """(directory, name, entries, declared) of package.json files (path, text): paths named as entries, and dependencies by name."""
    read = files.where(P.basename(F.col("path")) == "package.json").select(P.parent(F.col("path")).alias("directory"), F.from_json("text", MANIFEST, {"mode": "FAILFAST"}).alias("m"))
    nested = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'(?:^|[":\[,])\s*"?(\.?/?[\w@./-]+\.[cm]?[jt]sx?)"?\s*(?:$|[,}\]])'), 1)
    entries = F.array_distinct(F.filter(F.concat(F.array("m.main", "m.module", "m.types"), nested(F.col("m.bin")), nested(F.col("m.exports"))), lambda e: e.isNotNull()))
    declared = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array("m.dependencies", "m.devDependencies", "m.peerDependencies"), lambda d: F.coalesce(F.map_keys(d), F.array().cast("array<string>"))))))
    return read.select("directory", "m.name", F.transform(entries, lambda e: F.regexp_replace(e, r"^\./", "")).alias("entries"), declared.alias("declared"))


SECTIONS: dict[str, dict[str, type | tuple[type, ...]]] = {
    "analysis": {"exclude": list},
    "thresholds": {"cognitive": int, "cyclomatic": int, "nesting": int, "loc": int, "parameters": int, "crap": (int, float)},
    "regressions": {"cognitive": int, "cyclomatic": int, "nesting": int, "crap": (int, float)},
    "duplication": {"min_tokens": int, "min_lines": int},
    "rules": {"name": str, "source": str, "deny": list, "severity": str},
    "quality_gate": {"min_coverage": (int, float), "max_crap": (int, float), "max_rating": str},
    "sql": {"large_offset": int},
}


def configuration(text: str) -> dict[str, Any]:
    """Checked configuration of TOML; a section, key or type that isn't known is an error."""
    found = tomllib.loads(text)
    for section, values in found.items():
        known = SECTIONS.get(section)
        if known is None:
            raise ValueError(f"unknown section: {section}")
        for row in values if isinstance(values, list) else [values]:
            for key, value in row.items():
                if key not in known:
                    raise ValueError(f"unknown key: {section}.{key}")
                if not isinstance(value, known[key]) or isinstance(value, bool):
                    raise ValueError(f"wrong type: {section}.{key}")
    return found


def declares_tests(text: Column, language: Column) -> Column:
    """Does a file's own text declare tests, by its language's customs?"""
    return (
        F.when(language == "rust", text.rlike(r"#\[(?:\w+::)?test\]"))
        .when(language == "go", text.rlike(r"(?m)^func (?:Test|Benchmark|Fuzz)[A-Z_]\w*\("))
        .when(language == "python", text.rlike(r"(?m)^\s*(?:async )?def test_|unittest\.TestCase"))
        .when(language == "java", text.rlike(r"@(?:Parameterized)?Test\b"))
        .when(language == "zig", text.rlike(r'(?m)^test\s+"'))
        .when(language.isin("javascript", "typescript", "tsx"), text.rlike(r"(?m)^\s*(?:describe|it|test)(?:\.\w+)?\("))
        .otherwise(F.lit(False))
    )


def entry_point(path: Column, text: Column) -> Column:
    """Why a file is an entry by custom, or null: an index, a configuration, a crate root, a main function or guard."""
    name, language = P.basename(path), P.language(path)
    return (
        F.when(P.is_test(path), "test")
        .when(name.rlike(r"\.config\.[cm]?[jt]s$"), "configuration")
        .when(name.rlike(r"^(?:index|main)\.[cm]?[jt]sx?$"), "index")
        .when((language == "rust") & (path.rlike(r"(?:^|/)src/(?:main|lib)\.rs$|(?:^|/)src/bin/|(?:^|/)build\.rs$|(?:^|/)(?:examples|benches)/")), "crate_root")
        .when((language == "python") & text.rlike(r"(?m)^if __name__ == ['\"]__main__['\"]"), "main_guard")
        .when((language == "go") & text.rlike(r"(?m)^package main\b"), "main")
        .when(language.isin("c", "cpp") & ~name.rlike(r"\.h(?:pp)?$"), "translation_unit")
        .when((language == "java") & text.rlike(r"public static void main\("), "main")
        .when((language == "zig") & text.rlike(r"(?m)^pub fn main\("), "main")
    )
