"""Every registered query against its DuckDB twin on the smallest driver tables."""
import pytest

from ledgerlens.plans.registry import entries
from ledgerlens.plans.verify import compare

from .conftest import SMALL

NAMES = sorted(entries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_con, name):
    ok, msg = compare(spark, SMALL, name, duck_con)
    assert ok, msg


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(E.oracle_sql()) <= set(E.queries())
