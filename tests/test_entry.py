"""The driver's contract, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as contract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries) and {f"q{i:02d}" for i in range(1, 23)} <= set(oracle)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and {"l_returnflag", "sum_charge"} <= set(rows[0].asDict())


def test_without_the_corpus_folder(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert out.stdout.split()[1:] == ["False", "False", "True"], out.stderr


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "larkspur")):
        if f"{os.sep}llm" not in folder:
            for name in files:
                if name.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, name)).read()
