import pytest

from lexigrain.plans import queries as plans
from tests.compare import DATA, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, name):
    names, want = duck_rows(plans.oracle_sql()[name])
    got_names, got = spark_rows(plans.queries()[name](spark, str(DATA / "sf0.001")))
    assert got_names == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, str(DATA / "sf0.001")).count() > 0
