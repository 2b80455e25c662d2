"""Driver contract: entry() runs on sf0.001; every query has a callable; oracle keys exist."""

import __spark_entry__ as E


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert sum(r.n_queries for r in rows) > 0


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50
