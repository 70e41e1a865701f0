"""Driver contract and a smoke run of every registered query at sf0.001."""

import __spark_entry__ as E

from conftest import SF001


def test_contract(spark):
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert df.columns == ["path", "def_loc", "n_refs", "n_docs"]


def test_every_query_runs_small(spark):
    for name, fn in sorted(E.queries().items()):
        df = fn(spark, SF001)
        df.limit(5).collect()
        assert len(df.columns) == len(set(df.columns)), name
