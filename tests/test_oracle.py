"""Registered queries against their SQL at sf0.01. TRADEWIND_ALL=1 runs every query."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check import check, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.01"
SUBSET = ["src3", "snk4", "cln13", "cln15", "cln22", "jn10", "jn14", "ag2", "ag3", "ag13", "w1", "w2", "w5", "tk3", "bs5", "bs9", "bs10", "fe2", "md0", "md3", "md12", "sel2", "sel9", "sel14", "vf1", "vf3", "str1", "str2"]
NAMES = sorted(entry.queries()) if os.environ.get("TRADEWIND_ALL") else SUBSET


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees(spark, con, name):
    status, rows, *_, message = check(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert status != "FAIL", message
    assert rows > 0


def test_entry_runs_on_the_smallest_tables(spark):
    assert entry.entry(spark).count() == 6


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
