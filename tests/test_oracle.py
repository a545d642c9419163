"""Every query against its SQL equivalent in an independent engine."""

import pytest

import __spark_entry__ as contract
from verification import oracle, registry
from verification.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = dict(registry.QUERIES), oracle.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    with connect(SF_DIR) as opened:
        yield opened


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, connection, name):
    assert difference(QUERIES[name](spark, SF_DIR), connection, ORACLE[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sample_comes_from_the_flights(spark, connection):
    from collections import Counter

    from verification.fixture import ORACLE_MARKS, flights_sql

    sample = Counter(tuple(r) for r in QUERIES["sample_pairs"](spark, SF_DIR).collect())
    flights = flights_sql(ORACLE_MARKS, "lineitem")
    pairs = connection.execute(
        f"select dep_delay, arr_delay from ({flights}) where dep_delay + arr_delay is not null"
    ).fetchall()
    known = Counter(pairs)
    assert sum(sample.values()) == min(10_000, len(pairs)) and not sample - known
