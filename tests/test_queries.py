"""Every registered query of the library against its DuckDB equivalent."""

import pytest

from cairn.plans import registry

from .conftest import rows


#: Queries that SQL cannot express, with their own tests.
NO_SQL = {"vector_ann"}


def test_all_but_a_few_have_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_oracle(spark, sf, duck, name):
    got = rows(registry.QUERIES[name](spark, sf).toPandas())
    assert got == rows(duck.sql(registry.SQL[name]).df())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = registry.QUERIES["filter_by_time"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan
    assert "value" not in plan.split("ReadSchema")[1].split(">")[0]


def test_vector_delete_has_no_limit(spark, monkeypatch):
    store = spark.createDataFrame([(f"p{i}", f"{'error' if i < 150 else 'info'} {i}") for i in range(160)], "point_id string, template string")
    monkeypatch.setattr(registry, "_store", lambda s, d: store)
    assert {r["template"] for r in registry.QUERIES["vector_delete"](spark, "").collect()} == {f"info {i}" for i in range(150, 160)}
