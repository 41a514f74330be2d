"""Keyed state: rows that must agree, requests that close, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from judgeloom.streaming import keyed

ROW = "eval_index long, prediction string, score double, votes array<long>, at timestamp"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/in/{name}")


def taken(spark, folder, **more):
    return keyed.ingest_agreed(spark, f"{folder}/in/*", ROW, f"{folder}/log", f"{folder}/state", "eval_index", **more)


def logged(spark, folder):
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/log").collect())


def row(spark, k, **more):
    from datetime import datetime

    base = {"eval_index": k, "prediction": f"p{k}", "score": None if k % 3 == 0 else k / 7, "votes": [k, 2**60 + k], "at": datetime(2024, 1, 1, 0, 0, k % 60, 123456)}
    return tuple((base | more).values())


def test_same_rows_collapse_over_batches_and_restarts(spark, folder):
    put(spark, folder, "a", [row(spark, k) for k in range(20)] + [row(spark, 3)])
    assert taken(spark, folder) == 1 and len(logged(spark, folder)) == 20
    put(spark, folder, "b", [row(spark, k) for k in range(10, 30)])
    put(spark, folder, "c", [row(spark, k) for k in range(0, 30, 2)])
    assert taken(spark, folder, files_at_once=1) == 2
    assert logged(spark, folder) == sorted(row(spark, k) for k in range(30))
    assert taken(spark, folder) == 0 and len(logged(spark, folder)) == 30


@pytest.mark.parametrize("change", [{"prediction": "other"}, {"prediction": None}, {"score": 0.5}, {"votes": [9]}])
def test_a_row_that_differs_fails_inside_the_stream(spark, folder, change):
    put(spark, folder, "a", [row(spark, k) for k in range(5)])
    taken(spark, folder)
    put(spark, folder, "b", [row(spark, 4), row(spark, 7), row(spark, 2, **change)])
    for _ in range(2):  # and again after another restart
        with pytest.raises(Exception, match="conflicting rows for key 2"):
            taken(spark, folder)
    assert logged(spark, folder) == sorted(row(spark, k) for k in range(5))  # of the batch nothing was committed


def test_rows_that_differ_in_one_batch(spark, folder):
    put(spark, folder, "a", [row(spark, 1), row(spark, 1, score=0.25)])
    with pytest.raises(Exception, match="conflicting rows for key 1"):
        taken(spark, folder)


def test_null_keys_are_refused(spark, folder):
    put(spark, folder, "a", [row(spark, 1), row(spark, 2, eval_index=None)])
    with pytest.raises(Exception, match="row without eval_index"):
        taken(spark, folder)


EVENT = "user long, ts timestamp, kind string"
MINUTE = 60_000_000


def plain(events, quiet_us):
    """Sessions, one user after the other."""
    out = []
    for user in {u for u, _, _ in events}:
        own = sorted((t, k) for u, t, k in events if u == user)
        cut = [0, *(i for i in range(1, len(own)) if own[i][0] - own[i - 1][0] > quiet_us), len(own)]
        for a, b in zip(cut, cut[1:]):
            first = min((t for t, k in own[a:b] if k == "click"), default=None)
            q, f = own[a][0], own[b - 1][0]
            out.append((str(user), q, first, f, b - a, None if first is None else first - q, None if first is None else f - first, f - q))
    return sorted(out, key=str)


def put_events(spark, folder, name, events):
    spark.createDataFrame([(u, t, k) for u, t, k in events], "user long, us long, kind string").select("user", F.timestamp_micros("us").alias("ts"), "kind").coalesce(1).write.parquet(f"{folder}/in/{name}")


def closed(spark, folder, quiet_min=10, late="30 minutes"):
    return keyed.run_latencies(spark, f"{folder}/in/*", EVENT, f"{folder}/log", f"{folder}/state", "user", "ts", F.col("kind") == "click", quiet_min * 60_000, late, files_at_once=1)


def given(spark, folder):
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/log").collect()), key=str)


START = 1_704_067_200_000_000


def test_sessions_close_when_their_timers_fire(spark, folder):
    put_events(spark, folder, "a", [(1, START, "view"), (1, START + 3 * MINUTE, "click"), (2, START + MINUTE, "view")])
    assert closed(spark, folder) == 0 and given(spark, folder) == []
    put_events(spark, folder, "b", [(1, START + 9 * MINUTE, "view"), (3, START + 45 * MINUTE, "click")])  # the watermark is 15 minutes on
    closed(spark, folder)
    assert [r[0] for r in given(spark, folder)] == ["2"]  # user 1 is quiet until 19
    put_events(spark, folder, "c", [(3, START + 55 * MINUTE, "view")])
    closed(spark, folder)
    assert given(spark, folder) == [("1", START, START + 3 * MINUTE, START + 9 * MINUTE, 3, 3 * MINUTE, 6 * MINUTE, 9 * MINUTE), ("2", START + MINUTE, None, START + MINUTE, 1, None, None, 0)]


def test_late_events_are_counted_and_change_nothing(spark, folder):
    put_events(spark, folder, "a", [(1, START, "click"), (2, START + 120 * MINUTE, "view")])
    closed(spark, folder)
    before = given(spark, folder)
    assert [r[0] for r in before] == ["1"]
    put_events(spark, folder, "b", [(1, START + MINUTE, "view"), (9, START + 2 * MINUTE, "view"), (2, START + 121 * MINUTE, "click")])
    assert closed(spark, folder) == 2 and given(spark, folder) == before


def test_any_order_within_the_lateness_gives_the_batch_result(spark, folder):
    rng = random.Random(8)
    events = [(rng.randrange(6), START + rng.randrange(20 * MINUTE * 10), rng.choice(["view", "click", "error"])) for _ in range(300)]
    events = sorted(set(events), key=lambda e: e[1] + rng.randrange(25 * MINUTE))  # out of order by up to 25 minutes
    for k in range(0, 300, 100):
        put_events(spark, folder, f"{k:03}", events[k : k + 100])
        assert closed(spark, folder, quiet_min=4) == 0
    put_events(spark, folder, "end", [(99, START + 2000 * MINUTE, "view")])
    closed(spark, folder, quiet_min=4)
    assert given(spark, folder) == plain(events, 4 * MINUTE)
