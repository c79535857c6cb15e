"""The entry module with the corpus operators, without them, and without one of their parts."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [["tessera/llm", "tests/llm"], ["tessera/llm", "tests/llm", "corpus_pipeline.py"], ["tessera/llm/*"]])
def test_loads_without_the_corpus_operators(tmp_path, gone):
    top = tmp_path / "top"
    shutil.copytree(TOP, top, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt"))
    for g in gone:
        for path in top.glob(g):
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=top, env={**os.environ, "PYTHONPATH": str(top)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    total, corpus, covered = done.stdout.split()
    assert int(total) >= 100 and corpus == "0" and covered == "True"
