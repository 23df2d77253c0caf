"""Driver contract smoke test on sf0.001."""

from conftest import SF


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 24 and set(df.columns) >= {"diet", "tagged", "uncertain", "pct_of_total"}
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    for name in ("grade_distribution", "publish_summary", "review_batches", "pages_to_recipes"):
        assert qs[name](spark, SF).count() >= 1
