"""Every query of the engine against its SQL on the small tables."""

import pytest
from tests.conftest import same_rows

from tallyspark.functions import catalogue
from tallyspark.operators import engine_queries, guard_queries, metrics

QUERIES = metrics.queries() | engine_queries.queries() | guard_queries.queries()
ORACLES = metrics.oracle_sql() | engine_queries.oracle_sql() | guard_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    assert same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    assert len(rows)
    if "value" in rows and rows["value"].dtype == float:
        assert rows["value"].notna().any()


def test_every_recipe_is_bound():
    assert metrics.unbound() == []
    assert len([r for r in catalogue.load().values() if r.family not in ("catalog", "variants")]) == 626
