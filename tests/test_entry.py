import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) >= 40
