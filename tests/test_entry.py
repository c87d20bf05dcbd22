"""Driver contract of __spark_entry__.py."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["cd_gerfe", "gerfe"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    # names only from the SURVEY ids, no numbered anonymous ids
    assert all(k[0] in "absjkpuwfmo" and ("_" in k or k == "pipeline") for k in q)
