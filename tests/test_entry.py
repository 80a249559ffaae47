"""The library without the training-data operators."""

import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

SAYS = """
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), "pipeline" in e.queries(), any(n.startswith("op") for n in e.queries()))
"""


@pytest.mark.parametrize("without", [["reviewloom/llm"], ["reviewloom/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_imports_without_the_operators(tmp_path, without):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache")
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: set(skip(folder, names)) | _left_out(folder, names, without))
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    queries, checked, pipeline, operators = done.stdout.split()
    assert pipeline == "False" and int(queries) >= int(checked) > 60
    assert operators == str("reviewloom/llm" not in without and (ROOT / "reviewloom/llm").is_dir())


def _left_out(folder, names, without):
    from pathlib import Path

    return {name for name in names if str((Path(folder) / name).relative_to(ROOT)) in without}
