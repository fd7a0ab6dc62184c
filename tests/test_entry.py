"""The driver contract with and without the folder of pipeline operators."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("driftline/llm", "tests/llm"), ("driftline/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(g) for g in gone)))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    from workload.oracles import ORACLES
    from workload.queries import QUERIES

    assert list(map(int, out)) == [len(QUERIES), len(ORACLES), 0]
