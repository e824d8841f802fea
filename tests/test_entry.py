import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"student_id", "predicted_score", "risk_level", "topic", "final_rnk"} <= set(df.columns)


def test_registry_consistency():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
