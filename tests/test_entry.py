import __spark_entry__ as entry


def test_every_core_query_runs(spark, sf_dir):
    from sheafline import queries, queries_hr

    assert entry.entry(spark).limit(1).count() == 1
    for module in (queries, queries_hr):
        for name, f in module.QUERIES.items():
            df = f(spark, sf_dir)
            assert df.columns and len(set(df.columns)) == len(df.columns), name
            df.count()
        assert set(module.ORACLE) <= set(module.QUERIES)
    assert set(queries.QUERIES) | set(queries_hr.QUERIES) <= set(entry.queries())
