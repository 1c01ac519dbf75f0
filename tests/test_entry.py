"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
import pytest
from conftest import TESTDATA


def test_entry_returns_the_wide_table(spark):
    if not (TESTDATA / "sf0.001").exists():
        pytest.skip("no test tables here")
    table = contract.entry(spark)
    assert len(table.columns) == 35
    assert table.count() == 18


def test_every_query_is_registered_with_sql():
    assert set(contract.QUERIES) == set(contract.ORACLE_SQL)
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(callable(q) for q in contract.queries().values())


def test_core_queries_survive_a_missing_corpus_library():
    code = (
        "import sys, warnings; sys.modules['ahocorasick'] = None; warnings.simplefilter('error', ImportWarning)\n"
        "with warnings.catch_warnings(record=True) as said:\n"
        "    warnings.simplefilter('always')\n"
        "    import __spark_entry__ as entry\n"
        "assert 'area_indicators' in entry.queries() and not any(q.startswith('op') for q in entry.queries())\n"
        "assert any('ahocorasick' in str(w.message) for w in said) or not entry.CORPUS_QUERIES"
    )
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
