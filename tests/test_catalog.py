import __spark_entry__ as entry


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.revenue for r in rows] == sorted((r.revenue for r in rows), reverse=True)
