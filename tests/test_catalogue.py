"""Every query of the catalogue against its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from seqlake.plans.catalogue import ORACLES, QUERIES
from tests.conftest import MEDIUM


def plain(v):
    """A value in a form that both engines share."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_every_query_has_sql():
    assert {*ORACLES} == {*QUERIES}
    assert {*QUERIES} <= {*entry.queries()} and {*ORACLES} <= {*entry.oracle_sql()} <= {*entry.queries()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, MEDIUM)
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    want = Counter(tuple(map(plain, r)) for r in got.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
    assert want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
