"""The entry point without the optional training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from emberlog.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
PRINTED = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [False, True])
@pytest.mark.parametrize("left", [False, True])
def test_rest_works_without_the_subpackage(tmp_path, pipeline, left):
    """``pipeline``: corpus_pipeline.py is still there; ``left``: so is an empty folder of the subpackage."""
    shutil.copytree(ROOT / "emberlog", tmp_path / "emberlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if left:
        (tmp_path / "emberlog" / "llm" / "__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-c", PRINTED], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    names, sql = said.stdout.strip().splitlines()[-1].split(" | ")
    assert names.split() == sorted(QUERIES) and sql.split() == sorted(ORACLES)
