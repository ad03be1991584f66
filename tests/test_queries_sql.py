"""Every query that SQL can express equals its SQL."""

import pytest
from conftest import DATA, duck, same_rows

from meshlark.plans import registry


@pytest.fixture(scope="module")
def con():
    return duck(f"{DATA}/sf0.01")


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, con, name):
    same_rows(registry.queries()[name](spark, f"{DATA}/sf0.01"), con, registry.oracles()[name])
