"""Driver contract: entry() smoke, every registered query runs on sf0.001, every oracle key is registered."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "success_rate" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_runs_small(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF_SMALL)
        df.count()
        assert df.columns, name
