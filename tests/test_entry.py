import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) > 120
    for op in ("a01", "j08", "w05", "t01", "m07", "s02", "p13", "r01", "o06", "u02", "f03", "st2"):
        assert any(n.startswith(op + "_") for n in names), op


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.model for r in rows} == {"naive", "median"}
    assert all(r.custom_loss >= r.std_diff and r.rank in (1, 2) for r in rows)
