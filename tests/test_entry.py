import __spark_entry__ as entry


def test_names_and_sql_fit():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "crossings" in q


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
