"""The driver's entry points, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["id", "name", "father", "village"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    n = out.stdout.split()[0]
    assert int(n) > 50


def test_nothing_else_imports_the_subpackage():
    for d, _, names in os.walk(os.path.join(ROOT, "nothi")):
        if os.path.basename(d) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "nothi.llm" not in open(os.path.join(d, n), encoding="utf-8").read()
