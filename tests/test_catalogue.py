import pytest

from korvane import catalogue
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    out = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        same(out, catalogue.ORACLES[name], duck)
    else:
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
