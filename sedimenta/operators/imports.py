"""Imports and exports of source files: extraction, resolution to files, what is never used.

Extraction goes by patterns on lines and is no parser: it is for files that are written in the usual way. A
parser's rows of the same columns may take its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import paths as P
from sedimenta.operators.spans import nearest_ancestor

_SCRIPT = r"(?m)(?:^|[;\s])(?:import|export)\b[^'\"\n;]*?from\s*['\"]([^'\"]+)['\"]|(?:^|[;\s])import\s*['\"]([^'\"]+)['\"]|\b(?:require|import)\(\s*['\"]([^'\"]+)['\"]\s*\)"
_ONE = {
    "python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "go": r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$",
    "rust": r"(?m)^\s*(?:pub\s+)?(?:mod\s+(\w+)\s*;|use\s+((?:crate|super|self)[\w:]*))",
    "c": r"(?m)^\s*#\s*include\s*\"([^\"]+)\"",
    "zig": r"@import\(\"([^\"]+)\"\)",
}
SCRIPTS = ("javascript", "typescript", "tsx")
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def _all(text: Column, pattern: str, groups: int) -> Column:
    found = [F.regexp_extract_all(text, F.lit(pattern), g) for g in range(1, groups + 1)]
    return F.filter(F.array_distinct(F.concat(*found)), lambda x: x != "")


def extracted(files: DataFrame) -> DataFrame:
    """(path, language, specifier) of each import of files (path, text), each once."""
    language, text = P.language(F.col("path")), F.coalesce("text", F.lit(""))
    found = F.when(language.isin(*SCRIPTS), _all(text, _SCRIPT, 3))
    for name, groups in (("python", 2), ("java", 1), ("go", 1), ("rust", 2), ("zig", 1)):
        found = found.when(language == name, _all(text, _ONE[name], groups))
    found = found.when(language.isin("c", "cpp"), _all(text, _ONE["c"], 1))
    return files.select("path", language.alias("language"), F.explode(found).alias("specifier"))


def bare_package(specifier: Column) -> Column:
    """npm package of a specifier: ``@scope/name`` or the first part; null for relative ones and the platform's own."""
    name = F.when(specifier.startswith("@"), F.regexp_extract(specifier, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index(specifier, "/", 1))
    return F.when(~specifier.rlike(r"^(?:\.|/|node:|[a-z]+://)") & (name != ""), name)


def packages(imports: DataFrame) -> DataFrame:
    """(package, files) of the npm packages that scripts import."""
    return imports.where(F.col("language").isin(*SCRIPTS)).select(bare_package(F.col("specifier")).alias("package"), "path").where("package IS NOT NULL").groupBy("package").agg(F.countDistinct("path").alias("files"))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with target and state: resolved to one file, ambiguous, not_found, or external.

    Candidates are keys made of the specifier and equi-joined to the keys by which a file can be named, so no
    import meets a file that it doesn't name.
    """
    here = P.parent(F.col("path"))
    relative = F.col("specifier").startswith(".")
    beside = P.normalized(F.concat_ws("/", here, F.col("specifier")))
    dotted = F.translate(F.col("specifier"), ".", "/")
    rust = F.regexp_extract("specifier", r"^(\w+)$", 1)
    wanted = (
        F.when(F.col("language").isin(*SCRIPTS) & relative, F.array(beside))
        .when(F.col("language").isin("c", "cpp", "zig"), F.array(beside, P.normalized(F.col("specifier"))))
        .when(F.col("language").isin("python", "java"), F.array(dotted))
        .when((F.col("language") == "rust") & (rust != ""), F.array(P.normalized(F.concat_ws("/", here, rust))))
    )
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    keys = F.array_distinct(F.filter(F.array(
        F.col("path"), bare, F.when(P.basename(bare).isin("index", "mod", "__init__"), P.parent(F.col("path"))),
        F.when(P.language(F.col("path")).isin("python", "java"), F.regexp_replace(bare, r"^(?:src/main/java|src/test/java|src|lib)/", "")),
    ), lambda k: k.isNotNull()))
    named = files.select(F.col("path").alias("target"), F.explode(keys).alias("_key"))
    asked = imports.withColumn("_asked", F.explode_outer(F.filter(wanted, lambda k: k.isNotNull())))
    found = asked.join(named, F.col("_asked") == F.col("_key"), "left").groupBy("path", "language", "specifier").agg(F.countDistinct("target").alias("_n"), F.min("target").alias("_target"), F.max(F.col("_asked").isNotNull()).alias("_own"))
    state = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").when(F.col("_own") & (relative | F.col("language").isin("c", "cpp", "rust", "zig")), "not_found").otherwise("external")
    return found.select("path", "language", "specifier", F.when(F.col("_n") == 1, F.col("_target")).alias("target"), state.alias("state"))


def edges(resolutions: DataFrame) -> DataFrame:
    """(source, target, kind) of what is resolved."""
    return resolutions.where("state = 'resolved' AND path <> target").select(F.col("path").alias("source"), "target", F.lit("import").alias("kind")).distinct()


def exports(files: DataFrame) -> DataFrame:
    """(path, name) of what scripts export by name."""
    text = F.coalesce("text", F.lit(""))
    declared = F.regexp_extract_all(text, F.lit(r"(?m)^\s*export\s+(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+(\w+)"), 1)
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*export\s*\{([^}]*)\}"), 1), lambda x: F.transform(F.split(x, ","), lambda n: F.regexp_extract(F.trim(n), r"(\w+)$", 1))))
    scripts = files.where(P.language(F.col("path")).isin(*SCRIPTS))
    return scripts.select("path", F.explode(F.filter(F.array_distinct(F.concat(declared, listed)), lambda n: n != "")).alias("name"))


def imported_names(files: DataFrame) -> DataFrame:
    """(name) of all that any script imports by name, and ``*`` rows with the path for whole-module imports."""
    text = F.coalesce("text", F.lit(""))
    lists = F.regexp_extract_all(text, F.lit(r"(?:import|export)\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}\s*from"), 1)
    names = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda n: F.regexp_extract(F.trim(n), r"^(?:type\s+)?(\w+)", 1))))
    return files.where(P.language(F.col("path")).isin(*SCRIPTS)).select(F.explode(F.filter(names, lambda n: n != "")).alias("name")).distinct()


def unused_exports(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Exports (path, name) that nothing imports by name anywhere; files that are entries or tests don't count."""
    own = exports(files).where(~P.is_test(F.col("path")))
    return own.join(entries.select("path").distinct(), "path", "left_anti").join(imported_names(files), "name", "left_anti").select("path", "name")


def unused_dependencies(imports: DataFrame, manifests: DataFrame) -> DataFrame:
    """(directory, package) that a manifest declares and no script whose nearest manifest it is imports; types of a used package count as used."""
    used = nearest_ancestor(imports.where(F.col("language").isin(*SCRIPTS)).select("path", bare_package(F.col("specifier")).alias("package")).where("package IS NOT NULL"), manifests)
    used = used.select("directory", "package").distinct()
    typed = used.select("directory", F.concat(F.lit("@types/"), F.regexp_replace(F.regexp_replace("package", "^@", ""), "/", "__")).alias("package"))
    declared = manifests.select("directory", F.explode("declared").alias("package"))
    return declared.join(used.unionAll(typed), ["directory", "package"], "left_anti")


def covers(comments: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, line, fn) of suppression comments (path, line): the innermost function that holds the line, else the one that begins on the next."""
    from sedimenta.operators.spans import containing, innermost

    inside = innermost(containing(comments, functions, "path", "line", "start", "end", 50), ["path", "line"], "start", "end", "fn").select("path", "line", "fn")
    below = comments.join(functions.select("path", (F.col("start") - 1).alias("line"), F.col("fn").alias("_next")), ["path", "line"])
    beneath = below.groupBy("path", "line").agg(F.min("_next").alias("_next"))
    both = comments.select("path", "line").distinct().join(inside, ["path", "line"], "left").join(beneath, ["path", "line"], "left")
    return both.select("path", "line", F.coalesce("_next", "fn").alias("fn")).where("fn IS NOT NULL")
