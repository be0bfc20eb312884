"""Every query with SQL equals it; every other one runs."""

from __future__ import annotations

import pytest

from lithic.plans import catalogue
from tests.oracle import DATA, compare

NAMES = sorted(catalogue.oracle_sql())
#: Few links or nodes at the smallest scale.
LARGER = {"rul12_export_exemptions"}


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    assert compare(spark, name, "sf0.01" if name in LARGER else "sf0.001") in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(NAMES)))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, str(DATA / "sf0.001"))
    assert len(df.columns) == len(set(df.columns))
    df.collect()
