"""Stages that are skipped, rerun and resumed."""

import os

import pytest
from pyspark.sql import functions as F

from judgeloom.sources.stages import MARKER, Graph, Stage, identity, ordered, signatures


class Calls(list):
    """Makers that note their calls."""

    def numbers(self, spark, n):
        self.append("numbers")
        return spark.range(n)

    def doubled(self, spark, rows, by=2):
        self.append("doubled")
        return rows.select((F.col("id") * by).alias("id"))

    def total(self, spark, rows):
        self.append("total")
        return rows.agg(F.sum("id").alias("total"))

    def both(self, spark, a, b):
        self.append("both")
        return a.unionByName(b)

    def taken(self):
        out = list(self)
        self.clear()
        return out


def stages(calls, n=10, by=2):
    return [Stage("both", calls.both, ["numbers", "doubled"]), Stage("total", calls.total, ["doubled"]), Stage("doubled", calls.doubled, ["numbers"], {"by": by}), Stage("numbers", calls.numbers, settings={"n": n})]


def test_done_stages_are_skipped_and_changes_rerun_what_follows(spark, tmp_path):
    calls, folder = Calls(), str(tmp_path)
    graph = Graph(spark, folder, stages(calls))
    assert graph.plan() == [(n, "run") for n in ("numbers", "doubled", "both", "total")] and calls.taken() == [] and os.listdir(folder) == []
    assert graph.run()["total"].first()["total"] == 90 and calls.taken() == ["numbers", "doubled", "both", "total"]
    assert Graph(spark, folder, stages(calls)).run()["both"].count() == 20 and calls.taken() == []
    changed = Graph(spark, folder, stages(calls, by=3))
    assert dict(changed.plan()) == {"numbers": "skip", "doubled": "run", "both": "run", "total": "run"} and calls.taken() == []
    assert changed.run("total")["total"].first()["total"] == 135 and calls.taken() == ["doubled", "total"]
    assert Graph(spark, folder, stages(calls, n=4)).run("numbers").keys() == {"numbers"} and calls.taken() == ["numbers"]


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    calls, folder = Calls(), str(tmp_path)

    def killed(spark, rows):
        raise KeyboardInterrupt

    broken = [s if s.name != "total" else Stage("total", killed, s.reads) for s in stages(calls)]
    with pytest.raises(KeyboardInterrupt):
        Graph(spark, folder, broken).run("total")
    calls.clear()
    graph = Graph(spark, folder, stages(calls))
    half = graph.path("total")  # a writer that died before its marker
    spark.range(3).write.parquet(half)
    assert not graph.done("total") and graph.plan() == [("numbers", "skip"), ("doubled", "skip"), ("both", "run"), ("total", "run")]
    assert graph.run("total")["total"].first()["total"] == 90 and calls.taken() == ["total"]


def test_what_is_only_read_by_done_stages_is_not_needed(spark, tmp_path):
    calls = Calls()
    graph = Graph(spark, str(tmp_path), stages(calls))
    graph.run("total")
    calls.clear()
    os.remove(f"{graph.path('numbers')}/{MARKER}")
    assert graph.needed("total") == [] and graph.needed("both") == ["numbers", "both"]
    with pytest.raises(RuntimeError, match="numbers"):
        graph.result("numbers")


def test_inputs_count(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    sign = lambda: signatures([Stage("a", lambda s: s.read.parquet(source), inputs=identity(spark, source)), Stage("b", lambda s, x: x, ["a"])])
    before = sign()
    assert before == sign()
    spark.range(6).write.mode("overwrite").parquet(source)
    after = sign()
    assert before["a"] != after["a"] and before["b"] != after["b"]
    with pytest.raises(FileNotFoundError):
        identity(spark, source + "-none")


def test_clean(spark, tmp_path):
    calls, folder = Calls(), str(tmp_path)
    Graph(spark, folder, stages(calls)).run()
    (tmp_path / "mine-1").mkdir()
    graph = Graph(spark, folder, stages(calls, by=5))
    graph.run("doubled")
    gone = graph.clean()
    assert sorted(n.split("-")[0] for n in gone) == ["both", "doubled", "total"] and graph.done("doubled") and (tmp_path / "mine-1").exists()


def test_wrong_graphs():
    stage = lambda name, *reads: Stage(name, lambda spark: None, reads)
    assert [s.name for s in ordered([stage("c", "a", "b"), stage("b", "a"), stage("a")])] == ["a", "b", "c"]
    for wrong, says in (([stage("a", "b")], "a reads b"), ([stage("a"), stage("a")], "one name"), ([stage("a", "b"), stage("b", "c"), stage("c", "b")], "b -> c -> b")):
        with pytest.raises(ValueError, match=says):
            ordered(wrong)
