"""The entry module, with and without the optional package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q)"


def said(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, check=True, timeout=300).stdout.split()


@pytest.mark.parametrize("left", ["nothing", "pipeline", "an empty folder"])
def test_rest_stands_alone(tmp_path, left):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if left == "pipeline" else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    if left == "an empty folder":
        (copy / "threadloom" / "llm").mkdir()
    n, pipeline = said(copy)
    assert int(n) > 80 and pipeline == "False"


def test_whole():
    if not (ROOT / "threadloom" / "llm" / "queries.py").exists():
        pytest.skip("the optional package is not there")
    assert said(ROOT)[1] == "True"
