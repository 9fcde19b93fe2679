"""Every registered query against its SQL, run by another engine."""

import compare
import pytest

from tidemark.plans import registry

QUERIES = registry.queries()
CHECKS = registry.checks()


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, small, con, name):
    assert compare.difference(QUERIES[name](spark, small), con, CHECKS[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)
