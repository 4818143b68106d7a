import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from logsift.checks import analysis, parsing
from tests.compare import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    problem, *_ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None


@pytest.mark.parametrize("missing", ["", "xxhash", "public_tokenizers", "logsift.llm", "corpus_pipeline"])
def test_entry_without_parts(missing):
    """What the training-data operators need may be missing; the other queries stay."""
    code = f"import sys; sys.modules.update({{m: None for m in {missing!r}.split()}}); import __spark_entry__ as e; print(*e.queries())"
    names = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    core = {*parsing.QUERIES, *analysis.QUERIES}
    assert core <= set(names)
    if missing:
        assert core == set(names)
