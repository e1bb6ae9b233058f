"""The entry module and the library work without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_without_training_data(tmp_path, left):
    if not all(os.path.exists(os.path.join(ROOT, name)) for name in left):
        pytest.skip("already left out")
    for name in ("__spark_entry__.py", "oracle_queries.py", *left):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "cohortloom"), tmp_path / "cohortloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
