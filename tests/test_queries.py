"""Every registered query against its DuckDB SQL, at the smallest scale."""

import pytest

from tests.conftest import SF, same_rows
from voxelspark.plans import extended, oracles, queries

SQL = oracles.oracle_sql() | extended.extended_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(queries.REGISTRY[name](spark, SF).toPandas(), duck.execute(SQL[name]).df())


def test_queries_without_sql(spark):
    assert set(queries.REGISTRY) - set(SQL) == {"surface_decorrelation"}
    rows = queries.surface_decorrelation(spark, SF).orderBy("threshold").collect()
    assert [r["threshold"] for r in rows] == [0.25, 0.5, 1.0]
    ways = [r["decorrelation_um"] for r in rows if r["decorrelation_um"] is not None]
    assert ways == sorted(ways)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
