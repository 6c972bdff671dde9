import __spark_entry__ as entry
from sigmill import catalogue


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["user_id", "event_idx"]


def test_registry():
    q = entry.queries()
    assert set(catalogue.queries()) <= set(q) and set(entry.oracle_sql()) <= set(q)
    assert len(catalogue.oracle_sql()) >= 55
