from textweft import session


def test_small_and_large_key_tables_give_the_same(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "k int, t string")
    keys = spark.createDataFrame([(i, -i) for i in range(0, 80, 2)], "k int, v int")
    for how in ("inner", "left"):
        small, large = (session.attach(rows, keys, "k", how, most) for most in (1000, 0))
        assert sorted(small.collect()) == sorted(large.collect())
    assert session.only(rows, keys.select("k"), "k").count() == session.only(rows, keys.select("k"), "k", 0).count() == 25


def test_small_keys_leave_rows_in_place(spark):
    rows = spark.createDataFrame([(1, "a")], "k int, t string")
    plan = session.only(rows, spark.createDataFrame([(1,)], "k int"), "k")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_stored_and_checkpointed_tables(spark):
    rows = spark.range(10).selectExpr("id", "id % 3 AS g")
    for cut in (session.stored, session.checkpoint):
        kept = cut(rows)
        assert sorted(kept.collect()) == sorted(rows.collect()) and kept.columns == rows.columns
    assert session.stored(rows.where("id < 0")).count() == 0
    assert session.shared_folder(spark)


def test_package_reaches_the_workers(spark):
    def run(batches):
        import textweft.functions.text

        assert textweft.functions.text.GREEK_NAMES
        yield from batches

    assert session.map_arrow(spark.range(3), run, "id long").count() == 3
