import pytest

from korvane.llm import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf, duck, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], duck)
