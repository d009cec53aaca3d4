"""Every registered query runs; those with an oracle agree with DuckDB on the smallest scale."""

import pytest

from tallyspark.plans import registry

from .oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_agrees_with_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", ["ridge_crossfit", "temporal_check", "glm_odds_ratios", "fit_verification", "refit_paired"])
def test_estimators_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(r.asDict().get("passed", True) for r in rows)
