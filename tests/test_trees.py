"""Source trees, manifests, imports and what is never used, on a small tree of files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import paths as P
from sedimenta.operators import drift, imports, spans, telemetry, triage
from sedimenta.sources import trees

FILES = [
    ("package.json", '{"name": "root", "main": "./src/index.ts", "dependencies": {"left-pad": "1", "@s/x": "1", "gone": "1"}, "devDependencies": {"@types/left-pad": "1"}}'),
    ("web/package.json", '{"name": "web", "exports": {".": "./main.js"}, "dependencies": {"react": "1"}}'),
    ("src/index.ts", 'import { a, type B } from "./lib";\nimport "left-pad/fp";\nimport y from "@s/x/deep";\nimport z from "node:fs";\nimport "./nowhere";\n'),
    ("src/lib/index.ts", "export function a() {}\nexport const unusedOne = 1;\nexport { b as renamed };\n"),
    ("src/same.ts", 'import "./two";'),
    ("src/two.ts", ""),
    ("src/two.js", ""),
    ("web/main.js", "const r = require('react');\n"),
    ("py/pkg/mod.py", "import pkg.other\nfrom os import path\nif __name__ == '__main__':\n    pass\n"),
    ("pkg/other.py", "def test_x(): pass"),
    ("c/a.c", '#include "b.h"\n#include <stdio.h>\n'),
    ("c/b.h", ""),
    ("rs/src/main.rs", "mod util;\nuse std::io;\n#[test]\nfn x() {}\n"),
    ("rs/src/util.rs", ""),
    ("java/src/A.java", "import com.x.B;\n"),
    ("com/x/B.java", "class B {}"),
    ("none.ts", None),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_imports_are_extracted_and_resolved(files):
    found = imports.resolved(imports.extracted(files), files)
    got = {(r.path, r.specifier): (r.target, r.state) for r in found.collect()}
    assert got == {
        ("src/index.ts", "./lib"): ("src/lib/index.ts", "resolved"),
        ("src/index.ts", "left-pad/fp"): (None, "external"),
        ("src/index.ts", "@s/x/deep"): (None, "external"),
        ("src/index.ts", "node:fs"): (None, "external"),
        ("src/index.ts", "./nowhere"): (None, "not_found"),
        ("src/same.ts", "./two"): (None, "ambiguous"),
        ("web/main.js", "react"): (None, "external"),
        ("py/pkg/mod.py", "pkg.other"): ("pkg/other.py", "resolved"),
        ("py/pkg/mod.py", "os"): (None, "external"),
        ("c/a.c", "b.h"): ("c/b.h", "resolved"),
        ("rs/src/main.rs", "util"): ("rs/src/util.rs", "resolved"),
        ("java/src/A.java", "com.x.B"): ("com/x/B.java", "resolved"),
    }
    assert ("c/a.c", "c/b.h", "import") in rows(imports.edges(found))


def test_packages_and_unused_dependencies(files):
    found = imports.extracted(files)
    assert rows(imports.packages(found)) == [("@s/x", 1), ("left-pad", 1), ("react", 1)]
    listed = trees.manifests(files)
    assert rows(listed.select("directory", "name", F.array_join("entries", ","))) == [(".", "root", "src/index.ts"), ("web", "web", "main.js")]
    assert rows(imports.unused_dependencies(found, listed)) == [(".", "gone")]


def test_unused_exports(files):
    entries = files.where("path = 'src/index.ts'").select("path")
    assert rows(imports.unused_exports(files, entries)) == [("src/lib/index.ts", "renamed"), ("src/lib/index.ts", "unusedOne")]


def test_entries_by_custom(files):
    got = {r[0]: r[1] for r in files.select("path", trees.entry_point(F.col("path"), F.coalesce("text", F.lit("")))).collect() if r[1]}
    assert got == {"src/index.ts": "index", "src/lib/index.ts": "index", "web/main.js": "index", "py/pkg/mod.py": "main_guard", "c/a.c": "translation_unit", "rs/src/main.rs": "crate_root"}
    tests = {r[0] for r in files.where(trees.declares_tests(F.coalesce("text", F.lit("")), P.language(F.col("path")))).select("path").collect()}
    assert tests == {"pkg/other.py", "rs/src/main.rs"}


def test_discovery(spark, tmp_path):
    for name in ("a.py", "node_modules/x.js", "docs/b.min.js", "docs/c.js", "notes.txt", "q.sql"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path for r in trees.discover(spark, str(tmp_path), ("*.min.js",)).orderBy("path").collect()] == ["a.py", "docs/c.js"]
    assert [r.path for r in trees.discover(spark, str(tmp_path), (), "*.sql").collect()] == ["q.sql"]
    shot = trees.snapshot(trees.discover(spark, str(tmp_path)), "s1")
    assert shot.select("snapshot_id", "content_key").distinct().count() == 1


def test_name_status_and_scope(spark):
    df = trees.name_status(spark.createDataFrame([("A\tx/a",), ("D\tb",), ("M\tc",), ("R087\told\tx/new",), ("",)], "row string"))
    assert rows(df) == [("A", None, "x/a"), ("D", "b", None), ("M", "c", "c"), ("R", "old", "x/new")]
    assert rows(trees.in_scope(df, "new", "x").select("new")) == [("a",), ("new",)]


def test_configuration_refuses_what_it_does_not_know():
    assert trees.configuration("[thresholds]\ncognitive = 8\ncrap = 30.5\n") == {"thresholds": {"cognitive": 8, "crap": 30.5}}
    for text in ("[nope]\n", "[thresholds]\nx = 1\n", '[thresholds]\nloc = "1"\n', "[thresholds]\nloc = true\n", "[[rules]]\nwho = 1\n"):
        with pytest.raises(ValueError):
            trees.configuration(text)


def test_comments_cover_the_next_or_the_innermost_function(spark):
    functions = spark.createDataFrame([("a", "outer", 1, 50), ("a", "inner", 10, 20), ("a", "last", 60, 70)], "path string, fn string, start int, end int")
    comments = spark.createDataFrame([("a", 9), ("a", 15), ("a", 30), ("a", 55), ("a", 59)], "path string, line int")
    assert rows(imports.covers(comments, functions)) == [("a", 15, "inner"), ("a", 30, "outer"), ("a", 59, "last"), ("a", 9, "inner")]


def test_clone_drift(spark):
    schema = "group_id string, path string, fingerprint string"
    before = spark.createDataFrame([("g", "a", "1"), ("g", "b", "1"), ("g", "c", "2"), ("old", "x", "9")], schema)
    after = spark.createDataFrame([("g", "a", "1"), ("g", "d", "1"), ("new", "y", "8")], schema)
    assert rows(drift.clone_drift(before, after)) == [("g", "a", "1", "existing"), ("g", "c", "2", "removed"), ("g", "d", "1", "new"), ("new", "y", "8", "new"), ("old", "x", "9", "removed")]


def test_triage_weights_and_label_sets(spark):
    one = spark.range(1)
    none = F.lit(None).cast("double")
    assert one.select(triage.changed_weight([F.lit(3), F.lit(-2), none])).first()[0] == 3
    assert one.select(triage.debt_severity(F.lit(9.0), F.lit(5.0), none)).first()[0] == 4
    assert one.select(triage.debt_severity(F.lit(9.0), none, F.lit(-1.0))).first()[0] == 0
    assert one.select(triage.check_severity(F.lit(1), F.lit(2), F.lit(3))).first()[0] == 9
    df = spark.createDataFrame([("m", "ok"), ("m", "bad"), ("m", None)], "metric string, outcome string")
    assert rows(telemetry.valid(df, {"outcome": ("ok",)}, "metric", ["outcome"])) == [("m", "ok"), ("m", None)]
    top = triage.summary(spark.createDataFrame([("p", "f", 2, None), ("p", "g", 2, 1.0)], "path string, fn string, a int, b double"), ["a", "b"], 1)
    assert rows(top) == [("a", 1, "p", "f", 2.0), ("b", 1, "p", "g", 1.0)]


def test_nearest_ancestor_of_files_at_the_top(spark):
    files = spark.createDataFrame([("a",), ("x/y/b",)], "path string")
    dirs = spark.createDataFrame([(".",), ("x",)], "directory string")
    assert rows(spans.nearest_ancestor(files, dirs)) == [("a", "."), ("x/y/b", "x")]
