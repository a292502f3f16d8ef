"""The entry module: with all queries, and without what the text operators need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name}}", name=name)
sys.meta_path.insert(0, Blocked())
"""


def names(before=""):
    code = before + "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return [set(x.split()) for x in out.stdout.strip().splitlines()[-2:]]


@pytest.mark.parametrize("name", ["ahocorasick", "zstandard", "pursebook.llm", "corpus_pipeline"])
def test_the_ledger_survives_a_missing_part(name):
    queries, sql = names(BLOCK.format(name=name))
    assert queries == sql and "monthly_spend" in queries and not any(q.startswith("op1") or q == "pipeline" for q in queries)


def test_sql_is_for_queries_that_exist():
    queries, sql = names()
    assert sql <= queries and {"monthly_spend", "recurring_series"} <= sql
