"""Driver contract: entry runs, every SQL key is a query key."""

import importlib
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_registry(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["cluster", "rank", "term", "score"]
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 50
    assert all(callable(q) for q in qs.values())


@pytest.mark.parametrize("left_behind", [None, "quarry/llm", "quarry/llm/__pycache__"])
def test_entry_without_the_optional_package(tmp_path, left_behind):
    """With the optional folder gone, or emptied, the other queries register."""
    shutil.copytree(f"{ROOT}/quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left_behind:
        os.makedirs(tmp_path / left_behind)
    code = "import __spark_entry__ as E; q = E.queries(); assert set(E.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) >= 90, out.stderr[-500:]
