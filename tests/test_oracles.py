"""Every registered query of the library against its SQL, and the rows of those without SQL."""

from __future__ import annotations

import math

import pandas as pd
import pytest

from grainspark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = [None if x is None or (isinstance(x, float) and math.isnan(x)) else str(x) for x in df[c]]
        else:
            df[c] = df[c].astype(float).round(5)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got, want = normal(QUERIES[name](spark, sf_dir).toPandas()), normal(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype == object or b.dtype == object:
            assert all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True)), c
        else:
            assert all((pd.isna(x) and pd.isna(y)) or math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b, strict=True)), c


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.queries()) <= set(e.queries())
