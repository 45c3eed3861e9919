import __spark_entry__ as entry


def test_every_query_runs(spark, sf_dir):
    from sheafline.llm import queries

    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(entry.queries())
    columns = {
        "p1_found": ["record_id", "cluster_id"],
        "p4_found": ["dno", "ssn", "place"],
        "p5_found": ["id_a", "id_b"],
        "p7_found": ["doc_id", "item_id"],
        "p9_found": ["doc_id", "band"],
    }
    for name, f in queries.QUERIES.items():
        df = f(spark, sf_dir)
        assert df.columns == columns.get(name, df.columns)
        rows = df.count()
        if name in columns:
            assert df.distinct().count() == rows > 0
