"""The driver contract, whole and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as engine

REPO = Path(engine.__file__).resolve().parent


def test_queries_and_sql_share_names():
    found, sql = engine.queries(), engine.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 50
    assert all(callable(f) for f in found.values()) and all(isinstance(x, str) for x in sql.values())


@pytest.mark.parametrize("gone", [("sparkloom/llm", "tests/llm"), ("sparkloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_imports_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt"))
    for x in gone:
        path = copy / x
        shutil.rmtree(path, ignore_errors=True) if path.suffix == "" else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not any(n.startswith('op') for n in q); print(len(q))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
