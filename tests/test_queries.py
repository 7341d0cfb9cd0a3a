import pytest

from tellspan import queries, scenarios

QUERIES, ORACLES = queries.QUERIES | scenarios.QUERIES, queries.ORACLES | scenarios.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(agree, name):
    agree(QUERIES[name], ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and not set(queries.QUERIES) & set(scenarios.QUERIES)
