import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["l_returnflag", "l_linestatus", "sum_qty", "sum_price", "avg_qty", "n"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert all(callable(f) for f in entry.queries().values())
