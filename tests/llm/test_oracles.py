import pytest

from lexigrain.llm import queries as llm
from tests.compare import DATA, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, name):
    names, want = duck_rows(llm.oracle_sql()[name])
    got_names, got = spark_rows(llm.queries()[name](spark, str(DATA / "sf0.001")))
    assert got_names == names
    assert got == want


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs(spark, name):
    assert llm.queries()[name](spark, str(DATA / "sf0.001")).count() >= 0
