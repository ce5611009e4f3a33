"""The entry file without the corpus operators, or without a library that they need."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize(("lacking", "gone"), [("zstandard", "op10_warc"), ("markspan.llm", "pipeline"), ("corpus_pipeline", "pipeline")])
def test_the_other_queries_stay(lacking, gone):
    code = f"""
import sys
class Lacking:
    def find_spec(self, name, path=None, target=None):
        if name == {lacking!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Lacking())
import __spark_entry__ as entry
from markspan.plans.catalog import spark_queries, sql_queries
assert set(spark_queries()) <= set(entry.queries()) and set(sql_queries()) <= set(entry.oracle_sql())
assert {gone!r} not in entry.queries() and {gone!r} not in entry.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
