import pytest

from shapewright.llm import registry
from tests.oracle import connect, duck_rows, spark_rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_duckdb(spark, name, sf):
    at = f"/root/testdata/{sf}"
    got, columns = spark_rows(registry.queries()[name](spark, at))
    want, names = duck_rows(connect(at), registry.oracle_sql()[name])
    assert columns == names
    assert got == want
