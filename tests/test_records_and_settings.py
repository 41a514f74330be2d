"""Joins by index with their errors, and settings in columns."""

import pytest
from pyspark.sql import functions as F

from judgeloom.operators import metrics, records, settings
from judgeloom.sources import registry


def test_joins_by_index_name_their_faults(spark):
    data = spark.createDataFrame([(0, "a", 9), (1, "b", 9), (1, "c", 9), (2, None, 9)], "k long, subset string, score int")
    results = lambda *ks: spark.createDataFrame([(k, 5) for k in ks], "k long, score int")
    got = records.joined_by_index(results(0, 2), data, "k")
    assert got.columns == ["k", "score", "subset"]
    assert sorted(map(tuple, got.collect())) == [(0, 5, "a"), (2, 5, None)]
    assert records.joined_by_index(results(0).limit(0), data, "k").collect() == []
    for ks, said in (((0, 3), "k 3: out of range"), ((0, 0), "k 0: twice"), ((1,), "k 1: twice in the data"), ((None,), "k null: out of range")):
        with pytest.raises(Exception, match=said):
            # the count reads no column: the check must hold all the same
            records.joined_by_index(results(*ks), data, "k").count()
    faults = records.index_faults(results(0, 0, 1, 2, 3, None), data, "k")
    assert sorted(map(tuple, faults.collect()), key=str) == sorted([(0, "twice", 2), (1, "twice in the data", 1), (3, "out of range", 1), (None, "out of range", 1)], key=str)


def test_absent_fields_of_records(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": null}',), ("{}",), ("[1]",), (None,), ("no json",)], "r string")
    got = [r[0] for r in rows.select(records.absent(F.col("r"), ("c", "b", "a"))).collect()]
    assert got == [["c"]] + [["a", "b", "c"]] * 4


def test_settings_in_columns_are_judged_alike(spark):
    cases = [{}, {"vote": 0}, {"max_samples": -1}, {"max_samples": None}, {"noise_scale": -0.5, "gumbel_temperature": 0.0}, {"max_total_length": 200}, {"max_total_length": 265}, {"noise_scale": 0.0}]
    names = ("vote", "max_samples", "noise_scale", "gumbel_temperature", "max_total_length")
    plain = settings.as_dict(settings.Evaluation())
    rows = spark.createDataFrame([tuple((plain | c)[n] for n in names) for c in cases], "vote int, max_samples int, noise_scale double, gumbel_temperature double, max_total_length int")
    given = {n: F.col(n) for n in names}
    got = rows.select(settings.row_faults(**given).alias("f"), metrics.signature(settings.row_entries(**given)).alias("s")).collect()
    assert [r["f"] for r in got] == [settings.Evaluation(**c).faults() for c in cases]
    assert [r["s"] for r in got] == [settings.signature(settings.as_dict(settings.Evaluation(**c))) for c in cases]


def test_uses(spark):
    values = [" Semantic\n", "SEMANTIC", "fixed", "", None]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(settings.use(F.col("v"))).collect()
    assert [r[0] for r in got] == ["semantic", "semantic", None, None, None]
    assert [settings.normalise_use(v) for v in values[:2]] == ["semantic"] * 2
    with pytest.raises(ValueError):
        settings.normalise_use("fixed")


def test_subsets_that_count(spark):
    rows = spark.createDataFrame([("ifbench", "x"), ("ifbench", None), ("rm-bench", "rm-bench-chat"), ("rm-bench", "other"), (None, None)], "benchmark string, subset string")
    got = {(r["benchmark"], r["subset"]): r["n"] for r in registry.counted(rows).collect()}
    assert got["ifbench", None] == 2 and got["rm-bench", "rm-bench-chat"] == 1 and got["helpsteer3", None] == 0
    assert sum(got.values()) == 3
