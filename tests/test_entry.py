import __spark_entry__ as e


def test_names():
    names = set(e.queries())
    assert set(e.oracle_sql()) <= names
    assert "neighbourhood" in names


def test_shared_folder_follows_the_session(spark):
    from presq.plans.shared import materialize, shared_folder

    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    out = materialize(spark.range(5), "t")
    assert out.count() == 5
    assert out.inputFiles()[0].startswith(shared_folder(spark)[:20])


def test_index_is_consecutive(spark):
    from presq.plans.index import with_index

    got = [(r.i, r.name) for r in with_index(spark.createDataFrame([("b",), ("a",), ("c",)], "name string"), "name", "i").orderBy("i").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "c")]
