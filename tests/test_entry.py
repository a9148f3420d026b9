"""The driver's entry points, with and without the optional packages."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["l_orderkey", "total"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_optional_packages(tmp_path):
    shutil.copytree(os.path.join(ROOT, "weftline"), tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
