import pytest

shared = pytest.importorskip("corvane.llm._shared")


def test_scratch_tables_go(spark):
    df = shared.materialize(spark.range(3).toDF("x"), "t", release=True)
    assert df.count() == 3
    assert shared.drop_scratch(spark) >= 1 and shared.drop_scratch(spark) == 0
    kept = shared.materialize(spark.range(2).toDF("x"), "t")
    mark = shared.scratch_mark(spark)
    table = shared.sorted_buckets(spark.range(3).toDF("x"), "t", "x")
    assert table.count() == 3
    assert shared.drop_scratch(spark, since=mark) == 1 and kept.count() == 2
    other = spark.newSession()
    assert shared.drop_scratch(other) == 0 and shared.drop_scratch(spark) == 1


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    queries = entry.queries()
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in queries)
    assert "pipeline" in queries and set(entry.oracle_sql()) <= set(queries)
