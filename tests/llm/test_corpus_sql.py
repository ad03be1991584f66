"""Every corpus query that SQL can express equals its SQL over whole tables."""

import pytest
from conftest import DATA, duck, same_rows

from meshlark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    d = f"{DATA}/{sf}"
    same_rows(queries.QUERIES[name](spark, d), duck(d), queries.ORACLES[name])
