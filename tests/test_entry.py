import __spark_entry__ as e


def test_names():
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and "p2_found" in q and "p7_found" in q


def test_flagship(spark):
    assert e.entry(spark).columns == ["record_set", "source", "record_key", "snapshot_date", "change_kind"]
