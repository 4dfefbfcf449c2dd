"""Every core query with an SQL twin gives the twin's rows; the others run and give rows."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from strataquill.plans import registry


def rows(df) -> Counter:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, str):
            return v
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return str(v)

    return Counter(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0
