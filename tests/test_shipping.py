"""The library away from its folder, and without the libraries that only a part of it needs."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from .conftest import ROOT, SAMPLE

RUN = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
"""


def _python(code: str, folder, tmp_path) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run(
        [sys.executable, "-c", RUN + code], cwd=folder, env=env, capture_output=True, text=True, timeout=300
    )
    assert found.returncode == 0, found.stderr[-2000:]
    return found.stdout


def test_queries_with_python_workers_run_from_another_folder(tmp_path):
    pytest.importorskip("tidyroll.llm")
    code = f"""
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
print("rows", entry.queries()["op7_token_counts"](spark, {str(SAMPLE)!r}).count())
"""
    assert "rows 200" in _python(code, tmp_path, tmp_path)


@pytest.mark.parametrize("module", ["xxhash", "ahocorasick", "regex", "public_tokenizers", "tidyroll.llm"])
def test_the_reports_need_no_third_party_module(module, tmp_path):
    code = f"""
import importlib.abc

class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {module!r} or name.startswith({module!r} + "."):
            raise ModuleNotFoundError("No module named " + name, name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
print(sorted(entry.queries()) == sorted(entry.REPORTS), sorted(entry.oracle_sql()) == sorted(entry.REPORTS))
"""
    assert _python(code, tmp_path, tmp_path).strip() == "True True"
