"""The store of shards: what is opened, what is refused, what is used again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from judgeloom.sources import shard_store as S


def records(spark, n, first=0):
    return spark.range(first, n).select(F.col("id").alias("record_index"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), F.sequence(F.lit(0), F.col("id") % 3).alias("ids"))


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    S.write_store(records(spark, 2500).repartition(7, "name"), path, size=100, settings={"use": "semantic"})
    return path


def shards_read(rows):
    return rows.rdd.getNumPartitions()  # a partition a shard


def test_round_trip_and_manifest(spark, store):
    told = S.read_manifest(store)
    assert (told["num_records"], told["shard_size"], told["use"], len(told["shards"])) == (2500, 100, "semantic", 25)
    assert sorted(os.listdir(store)) == sorted([*(S.shard_name(k, k + 100) for k in range(0, 2500, 100)), S.MANIFEST])
    assert sorted(S.read_store(spark, store).collect()) == sorted(records(spark, 2500).collect())
    assert S.read_store(spark, store, "name").columns == ["name"] and S.read_store(spark, store, "name").distinct().count() == 2500


@pytest.mark.parametrize(("where", "n", "shards"), [("record_index = 731", 1, 1), ("record_index in (5, 99, 2499)", 3, 2), ("record_index >= 2450", 50, 1), ("record_index > 1199 and record_index <= 1305", 106, 2), ("record_index < 0", 0, 1), ("name = 'r7'", 1, 25), ("record_index < 250 and name like '%7'", 25, 3)])
def test_only_shards_that_a_filter_needs(spark, store, where, n, shards):
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        rows = S.registered(spark).read.format("shards").option("path", store).option("pushdown", True).load().where(where)
        assert shards_read(rows) == shards and rows.count() == n
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize(("low", "high", "n", "shards"), [(0, None, 2500, 25), (120, 334, 214, 3), (2450, None, 50, 1), (700, 700, 0, 1), (2500, 9000, 0, 1)])
def test_only_shards_of_a_range(spark, store, low, high, n, shards):
    rows = S.read_store(spark, store, low=low, high=high)
    assert shards_read(rows) <= shards and rows.count() == n and {r["record_index"] for r in rows.collect()} == set(range(low, min(2500, high if high is not None else 2500)))


def test_one_frame_under_several_filters(spark, store):
    rows = S.read_store(spark, store)
    assert rows.where("record_index < 10").unionByName(rows.where("record_index >= 2490")).count() == 20
    assert rows.where("record_index = 3").count() == 1 and rows.count() == 2500


def test_other_shards_need_not_be_there(spark, store):
    for k in range(100, 2500, 100):
        os.rename(f"{store}/{S.shard_name(k, k + 100)}", f"{store}/gone{k}")
    assert S.read_at(spark, store, 42).first()["name"] == "r42"
    with pytest.raises(Exception, match="batch_100_200"):
        S.read_at(spark, store, 142).collect()


def test_by_index(spark, store):
    assert {r["record_index"] for r in S.read_at(spark, store, -1, 0, -2500, 1234).collect()} == {2499, 0, 1234}
    assert shards_read(S.read_at(spark, store, -1)) == 1
    for k in (2500, -2501):
        with pytest.raises(IndexError):
            S.read_at(spark, store, k)


def test_finished_store_is_used_again(spark, store):
    before = {f: os.stat(f"{store}/{f}").st_mtime_ns for f in os.listdir(store)}
    S.write_store(records(spark, 2500), store, size=100, settings={"use": "semantic"})
    assert before == {f: os.stat(f"{store}/{f}").st_mtime_ns for f in os.listdir(store)}
    with pytest.raises(RuntimeError, match="use"):
        S.write_store(records(spark, 2500), store, size=100, settings={"use": "even"})
    with pytest.raises(RuntimeError, match="shard_size"):
        S.write_store(records(spark, 2500), store, size=50, settings={"use": "semantic"})


def test_partial_store_is_an_error(spark, store):
    os.remove(f"{store}/{S.MANIFEST}")
    for act in (lambda: S.read_manifest(store), lambda: S.write_store(records(spark, 2500), store, size=100), lambda: S.read_store(spark, store).count()):
        with pytest.raises(Exception, match="Incomplete store"):
            act()
    with pytest.raises(RuntimeError, match="No store"):
        S.read_manifest(store + "-none")


def test_shard_with_other_rows_is_an_error(spark, store):
    os.replace(f"{store}/{S.shard_name(0, 100)}", f"{store}/x")
    S.write_store(records(spark, 60), store + "2", size=100)
    os.replace(f"{store}2/{S.shard_name(0, 60)}", f"{store}/{S.shard_name(0, 100)}")
    with pytest.raises(Exception, match="has 60 records"):
        S.read_store(spark, store).collect()


@pytest.mark.parametrize(("make", "says"), [
    (lambda spark: records(spark, 300).where("record_index <> 150"), "incomplete"),
    (lambda spark: records(spark, 300).where("record_index not between 100 and 199"), "gap"),
    (lambda spark: records(spark, 300, first=1), "gap|misplaced|incomplete"),
    (lambda spark: records(spark, 300).unionByName(records(spark, 6)), "twice"),
    (lambda spark: records(spark, 300).withColumn("record_index", F.when(F.col("record_index") != 7, F.col("record_index"))), "null"),
])
def test_refused_writes_leave_nothing(spark, tmp_path, make, says):
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match=says):
        S.write_store(make(spark), path, size=100)
    assert not os.path.exists(path)


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert S.write_store(records(spark, 0), path)["num_records"] == 0
    assert S.read_store(spark, path).collect() == []


def test_range_faults():
    assert S.range_faults([(0, 10), (10, 20)], 20) == []
    assert S.range_faults([(0, 10), (12, 20), (18, 30), (30, 30)], 40) == [(10, 12, "gap"), (18, 20, "overlap"), (30, 30, "empty"), (30, 40, "gap")]


def test_shard_faults(spark):
    names = [("a", "batch_0_10.pt"), ("a", "x/batch_0_10.parquet"), ("a", "batch_10_20.parquet"), ("b", "batch_0_10.parquet"), ("b", "batch_12_20.parquet"), ("b", "batch_18_30.parquet"), ("b", "batch_30_30.parquet"), ("c", "batch_0_9.parquet")]
    out = S.shard_faults(spark.createDataFrame(names, "store string, file string"), spark.createDataFrame([("a", 20), ("b", 40), ("c", 5), ("d", 3)], "store string, n long"))
    assert {tuple(r) for r in out.collect()} == {("a", None, None, "name batch_0_10.pt"), ("b", 10, 12, "gap"), ("b", 18, 20, "overlap"), ("b", 30, 30, "empty"), ("b", 30, 40, "gap"), ("c", 5, 9, "beyond"), ("d", 0, 3, "gap")}


def test_manifest_is_plain_json(store):
    with open(f"{store}/{S.MANIFEST}", encoding="utf-8") as f:
        assert json.load(f)["shards"][3] == {"file": "batch_300_400.parquet", "start": 300, "end": 400}
