"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import compare, connect

from tidemark.plans.catalog import all_queries

QUERIES = all_queries()
#: Queries that are empty on the smallest tables.
MAY_BE_EMPTY = {"set_except", "metrics_series_dedupe"}


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_sql(spark, con, sf_small, name):
    said = compare(spark, con, QUERIES[name], sf_small)
    assert said == "" or said == "no rows", said


def test_contract():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {f"p{i}_found" for i in (1, 2, 3, 4, 5, 7)} <= set(entry.queries())


def test_core_stands_without_the_llm_part(tmp_path):
    """With both folders deleted, the entry module offers the queries of the core, and nothing of the core needs them."""
    root = Path(__file__).resolve().parent.parent
    for part in ("tidemark", "tests"):
        shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, sys; print(len(e.queries())); assert not any('llm' in m for m in sys.modules if m.startswith('tidemark'))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == str(len(QUERIES)), said.stderr


def test_a_broken_llm_part_is_an_error(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    for name in [m for m in sys.modules if m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.plans.registry", None)
    try:
        import tidemark.llm  # noqa: F401
    except ModuleNotFoundError:
        pytest.skip("no llm part")
    with pytest.raises(ImportError):
        entry.queries()


def test_entry_runs(spark):
    df = importlib.import_module("__spark_entry__").entry(spark)
    assert df.limit(1).count() == 1 and df.columns[:3] == ["geo", "fips", "metro"]


def test_the_log_is_scanned_once(spark, sf_small):
    """The as-of fan-out reads its log once, whatever the number of dates, and keeps only the columns it needs."""
    from tidemark.plans.point_in_time import log, origin_dates
    from tidemark.operators.vintage import as_of_each

    plan = as_of_each(log(spark, sf_small), origin_dates(spark, sf_small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    assert "temp_mean_f" not in plan and "news_n" not in plan
