"""The driver's entry points, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_entry_gives_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "path"
    assert df.count() > 0


def test_oracles_belong_to_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["sedimenta/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], ["sedimenta/llm", "tests/llm"]])
def test_the_rest_works_without(tmp_path, gone):
    shutil.copytree(ROOT / "sedimenta", tmp_path / "sedimenta", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hotspots' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "sedimenta").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sedimenta.llm" not in path.read_text(), path
