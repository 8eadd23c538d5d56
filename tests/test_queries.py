"""Every registered query next to its reference SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from landshift.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


# a gradient fit has no SQL
NO_SQL = {"pixel_classifier"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    out = compare.compare(spark, con, name, SF)
    assert out.startswith("ok") or (name in NO_SQL and out.startswith("rows-only")), out


def test_entry(spark):
    assert entry.entry(spark).count() == 6
