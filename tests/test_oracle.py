"""Every registered query against its SQL, on the smallest data."""

import os

import pytest
from oracle import DATA, compare

from millrace.queries import load_all

SF = os.environ.get("ORACLE_SF", "sf0.001")
QUERIES = load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/{SF}"), reason="no test data")

#: Nothing qualifies on the smallest tables.
MAY_BE_EMPTY = {"live_scope", "stream_correlated_incidents", "fedavg_quorum", "fedavg_participants", "unplaceable_tasks"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    fn, sql = QUERIES[name]
    difference = compare(spark, SF, fn, sql)
    if difference == "both empty" and name in MAY_BE_EMPTY:
        return
    assert difference is None, difference


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
