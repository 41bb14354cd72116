"""Every registered query with an oracle agrees with DuckDB on the smallest data."""

import pytest
from compare import connect, difference

from srcgraph import catalog

FOLDER = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(autouse=True)
def checked_plans(spark, monkeypatch):
    """Every plan that is checkpointed on the way is free of cross joins too."""
    kind = type(spark.range(1))
    checkpoint = kind.checkpoint

    def checked(frame, *args, **kwargs):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, plan
        return checkpoint(frame, *args, **kwargs)

    monkeypatch.setattr(kind, "checkpoint", checked)


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, database, name):
    def run(session, folder):
        frame = catalog.QUERIES[name](session, folder)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        return frame

    assert difference(spark, database, FOLDER, run, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
