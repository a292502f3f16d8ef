from types import SimpleNamespace

import pytest

from pursebook.llm import common


def session(master, folder=None):
    kept = {"spark.checkpoint.dir": folder}
    conf = SimpleNamespace(get=lambda k, d=None: kept.get(k) or d, set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError):
        common.shared_dir(session(master))
    assert common.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_local_mode_makes_one_folder_and_keeps_it():
    s = session("local[4]")
    assert common.shared_dir(s) == common.shared_dir(s)


def test_stored_tables_can_be_discarded(spark):
    import os

    table = common.stored(spark.range(3), "t")
    assert table.count() == 3
    common.discard(table)
    assert not os.path.exists(table.stored_at.removeprefix("file:"))


def test_salted_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).selectExpr("id", "IF(id < 300, 7, id % 50) AS k")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k % 2 = 1")
    want = sorted(map(tuple, rows.join(table, "k").select("id", "k", "n").collect()))
    for total in (None, 500):
        for merge in (False, True):
            assert sorted(map(tuple, common.salted_join(rows, table, "k", "id", "n", total=total, merge=merge).select("id", "k", "n").collect())) == want
    assert common.salted_join(rows, table, "k", "id", "n", "left").count() == 500


def test_very_hot_keys_are_dealt_into_more_parts(spark, monkeypatch):
    for name, value in (("HOT_ROWS", 10), ("PART_ROWS", 20), ("SALTS", 2)):
        monkeypatch.setattr(common, name, value)
    rows = spark.range(500).selectExpr("id", "IF(id < 300, 7, id % 50) AS k")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.salted_join(rows, table, "k", "id", "n", total=500)
    assert sorted(map(tuple, got.select("id", "k", "n").collect())) == sorted(map(tuple, rows.join(table, "k").select("id", "k", "n").collect()))


def test_the_filter_grows_with_its_keys_or_gives_way_to_a_join(spark):
    rows, keys = spark.range(1000).selectExpr("id AS k", "id % 7 AS x"), spark.range(0, 1000, 3).selectExpr("id AS k").union(spark.range(0, 30, 3).selectExpr("id AS k"))
    want = {r.k for r in keys.collect()}
    for total in (None, 334, common.FILTER_BITS // 8, common.MOST_BITS):
        kept = common.may_hold(rows, keys, "k", total)
        assert kept.columns == ["k", "x"] and want <= {r.k for r in kept.collect()} and kept.count() <= 340
    assert common.may_hold(rows, keys, "k", common.MOST_BITS).count() == 334


def test_ids_that_are_no_numbers_are_refused(spark):
    from pursebook.llm import decontaminate, near_dup

    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    for f in (near_dup.near_duplicate_groups, near_dup.one_row_per_group):
        with pytest.raises(TypeError):
            f(docs)
    with pytest.raises(TypeError):
        decontaminate.without_benchmark(docs, docs.withColumnRenamed("doc_id", "item_id"))
    items = spark.createDataFrame([(1, "some text")], "item_id int, text string")
    assert decontaminate.find_benchmark_windows(docs, items).first().n_words == 2
