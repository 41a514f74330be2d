"""Exact line numbers over splits, faults by file and line, counts on the way."""

import gzip
import json
import random

import pytest

from judgeloom.sources import json_files, line_numbers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, lines, zipped=False):
    with gzip.open(path, "wt") if zipped else open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_numbers_over_many_splits(small_splits, tmp_path):
    rng = random.Random(1)
    files = {f"{name}.jsonl": [f"{name} {k} " + "x" * rng.choice([0, 5, 300, 5000]) for k in range(1, n + 1)] for name, n in (("a", 400), ("b", 1), ("c", 77))}
    for name, lines in files.items():
        write(tmp_path / name, lines)
    write(tmp_path / "d.jsonl.gz", files["a.jsonl"], zipped=True)
    assert line_numbers.split_lines(small_splits, str(tmp_path)).select("file", "block").distinct().count() > 30
    got = line_numbers.numbered_lines(small_splits, str(tmp_path)).collect()
    want = {(name, k, line) for name, lines in [*files.items(), ("d.jsonl.gz", files["a.jsonl"])] for k, line in enumerate(lines, 1)}
    assert len(got) == len(want) and {(r["file"].rsplit("/", 1)[1], r["number"], r["line"]) for r in got} == want


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize(("fault", "at"), [('{"a": ', 300), ("[1]", 1), ("7", 500), ("nope", 411)])
def test_the_error_names_file_and_line(small_splits, tmp_path, zipped, fault, at):
    lines = [json.dumps({"a": k, "t": "x" * 30}) for k in range(1, 501)]
    path = str(tmp_path / ("log.jsonl" + ".gz" * zipped))
    write(path, lines, zipped)
    assert json_files.read_strict(small_splits, path, "a long").count() == 500
    write(path, [*lines[: at - 1], fault, *lines[at:]], zipped)
    with pytest.raises(Exception, match=rf"log.jsonl{'.gz' * zipped}, line {at}: "):
        json_files.read_strict(small_splits, path, "a long").collect()


def test_states(small_splits, tmp_path):
    lines = [json.dumps({"a": k, "t": "x" * 30}) for k in range(1, 201)]
    lines[99], lines[149], lines[199] = "  ", "[", "null"
    write(tmp_path / "l", lines)
    out = json_files.line_states(small_splits, str(tmp_path / "l")).where("state <> 'ok'").collect()
    assert {(r["number"], r["state"]) for r in out} == {(100, "blank"), (150, "malformed"), (200, "not_object")}


def test_counts_come_from_the_pass_that_reads(small_splits, tmp_path):
    lines = [json.dumps({"a": k}) if k % 10 else "{" for k in range(1, 301)] + ["", " "]
    write(tmp_path / "l", lines)
    rows, seen = json_files.read_counted(small_splits, str(tmp_path / "l"), "a long")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "CollectMetrics" in plan
    assert {r["a"] for r in rows.collect()} == {k for k in range(1, 301) if k % 10}
    assert seen.get == {"read": 270, "skipped": 30, "blank": 2}
