"""Table functions from SQL, against the functions they call."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from judgeloom.functions import tables
from judgeloom.operators import metrics, traces

TEXTS = ["One. Two! Three", "a, b; c. `x. y` d. e", None, "", "Dr. No. Yes. (in. side) out. End", "**Response A:** Criterion 1 [Hard Rule]: Met Justification: x"]


@pytest.fixture
def sql(spark):
    tables.register(spark)
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").createOrReplaceTempView("texts")
    return lambda q: [tuple(r) for r in spark.sql(q).collect()]


@pytest.mark.parametrize("soft", [True, False])
def test_cuts(sql, soft):
    got = sql(f"SELECT id, c.cut FROM texts, LATERAL sentence_cuts(text, {soft}) c")
    assert sorted(got) == [(i, p) for i, t in enumerate(TEXTS) if t is not None for p in traces.cuts(t, soft)]


def test_joins_and_groups(sql):
    got = dict(sql("SELECT id, count(c.cut) FROM texts JOIN LATERAL sentence_cuts(text, false) c WHERE c.cut > 3 GROUP BY id"))
    assert got == {i: n for i, t in enumerate(TEXTS) if (n := sum(p > 3 for p in traces.cuts(t)))}


def test_criteria_of_literals(sql):
    head = "Response A:\\nCriterion 1 [Hard Rule]: Met\\nJustification: fine"
    assert sql(f"SELECT * FROM trace_criteria('{head}')") == [("A", 1, "hard rule", "met", "fine")]
    assert sql("SELECT * FROM segment_trace('no headers')") == [] and sql("SELECT * FROM segment_trace(CAST(NULL AS STRING))") == []


def test_views_of_a_table(spark, sql):
    spark.createDataFrame([(7, [1], [5, 6, 7, 8, 9], [2, 4, 5]), (8, [], [3], [1]), (9, [1], [2], []), (9, [1], None, [1])], "k long, prefix array<int>, ids array<int>, ends array<int>").createOrReplaceTempView("records")
    got = sorted(sql("SELECT k, view, frontier, target_start, input, labels FROM prefix_views(TABLE(records) PARTITION BY (k), 2)"))
    assert got == [
        (7, 0, 2, 4, [1, -1, 0, 0, 5, 6, 7, 8, -2], [-100] * 4 + [5, 6, 7, 8, -2]),
        (7, 1, 3, 5, [1, -1, 0, 0, 0, 5, 6, 7, 8, 9, -2], [-100] * 5 + [5, 6, 7, 8, 9, -2]),
        (8, 0, 1, 2, [-1, 0, 3, -2], [-100, -100, 3, -2]),
        (8, 1, 1, 2, [-1, 0, 3, -2], [-100, -100, 3, -2]),
    ]


@pytest.mark.parametrize(("q", "says"), [
    ("SELECT * FROM segment_trace(1)", "must be of string"),
    ("SELECT * FROM sentence_cuts('a', 'b')", "must be of boolean"),
    ("SELECT * FROM prefix_views(TABLE(texts) PARTITION BY (id), 2)", "array of integers"),
    ("SELECT * FROM prefix_views('a', 2)", "TABLE argument"),
])
def test_arguments_are_checked_before_the_query_runs(spark, sql, q, says):
    with pytest.raises(Exception, match=says):
        spark.sql(q)


def test_bags(spark):
    rng = random.Random(2)
    rows = [(k, rng.choices("abcdeé", k=rng.randrange(9)), rng.choices("abcdeé", k=rng.randrange(9))) for k in range(200)] + [(900, [], []), (901, ["a"], []), (902, ["a"] * 40, ["a"] * 7 + ["b"])]
    out = spark.createDataFrame(rows, "i long, a array<string>, b array<string>").select("i", metrics.bag_overlap(F.col("a"), F.col("b")).alias("n"), metrics.bag_f1(F.col("a"), F.col("b")).alias("f"))
    got = {r["i"]: (r["n"], r["f"]) for r in out.collect()}
    for i, a, b in rows:
        n = sum((Counter(a) & Counter(b)).values())
        assert got[i] == (n, 2.0 * n / (len(a) + len(b)) if a and b else float(a == b)), (a, b)


def test_words_of_empty_sides(spark):
    rows = [(1, [], []), (2, None, None), (3, ["a"], []), (4, None, ["a"]), (5, ["a", "b"], ["b", "c"])]
    out = metrics.word_f1(spark.createDataFrame(rows, "doc_id long, candidate array<string>, reference array<string>"))
    assert {r["doc_id"]: r["f1"] for r in out.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.5}


def test_long_bags_take_linear_time(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(200_000)), lambda k: F.concat(F.lit("w"), (k % 50_000).cast("string")))
    assert spark.range(1).select(metrics.bag_overlap(words, F.slice(words, 1, 60_000)).alias("n")).first()["n"] == 60_000
