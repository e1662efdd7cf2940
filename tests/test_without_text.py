"""The screening side without the text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]

SCRIPT = """
import __spark_entry__ as entry
from vettra.session import local_session
names = set(entry.queries())
assert not {n for n in names if n.startswith("op") and n[2:3].isdigit()} and "pipeline" not in names
assert set(entry.oracle_sql()) <= names and "escalations" in names
import tests.test_queries
spark = local_session("without", 2, 2)
assert entry.queries()["canonical_names"](spark, %r).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_text_folders(tmp_path, pipeline):
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT % data], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300,
        env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")},
    )
    assert done.returncode == 0, done.stderr[-2000:]
