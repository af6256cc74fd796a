import subprocess
import sys
import tempfile
from pathlib import Path

import pytest

import __spark_entry__ as driver
from quillshard.llm.registry import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, connect

ROOT = Path(__file__).resolve().parents[2]

PROGRAM = """
import sys
sys.path.insert(0, {root!r})

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r} or name.startswith({gone!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print([k for k in e.queries() if not k.startswith("q_")])
"""


def test_one_query_for_each_operator_and_the_pipeline():
    names = [k for k in driver.queries() if not k.startswith("q_")]
    assert sorted(int(k[2:].split("_")[0]) for k in names if k.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_registered_queries_equal_sql(spark, name):
    problem, _ = compare(spark, connect(SF_SMALL), name, SF_SMALL)
    assert not problem


@pytest.mark.parametrize("gone", ["quillshard.llm", "corpus_pipeline"])
def test_the_entry_imports_without_the_operators(gone):
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(root=str(ROOT), gone=gone)], cwd=tempfile.gettempdir(), capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "[]", done.stderr[-1000:]
