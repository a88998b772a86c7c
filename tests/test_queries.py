"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest

from conftest import SF
from metaloom import catalog


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    known = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(known.columns)
    assert sorted(df.columns) == columns
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [known.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in known.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_digests_of_categories_hold_no_rows_in_one_place(spark):
    plan = catalog.stale_categories(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" in plan and "collect_list" not in plan
