import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from judgeloom.operators import refine, traces
from judgeloom.plans import catalogue
from judgeloom.sources import benchmarks as B
from judgeloom.sources import json_files as J
from judgeloom.streaming import resume

SF = "/root/testdata/sf0.001"


def fails(df, what):
    with pytest.raises(Exception, match=what):
        df.collect()


def test_json_levels(spark, tmp_path):
    good, tail, middle, odd, blank = (tmp_path / n for n in ("good", "tail", "middle", "odd", "blank"))
    good.write_text('{"a": 1}\n{"a": 2, "z": 0}\n')
    tail.write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    middle.write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    odd.write_text('{"a": 1}\n[1]\n')
    blank.write_text('{"a": 1}\n \n{"a": 2}\n')
    values = lambda df: sorted(r["a"] for r in df.collect())
    read = lambda f, p, **o: f(spark, str(p), "a int", **o)
    assert values(read(J.read_strict, good)) == [1, 2] == values(read(J.read_strict, blank))
    for p in (tail, middle, odd):
        fails(read(J.read_strict, p), "Not a JSON object")
    fails(read(J.read_strict, blank, skip_blank=False), "Not a JSON object")
    rows, skipped = read(J.read_lenient, middle)
    assert values(rows) == [1, 3] and skipped.count() == 1
    assert values(read(J.read_recovering, tail)) == [1, 2] and tail.read_text().endswith('{"a": ')
    for p, what in ((middle, "Malformed"), (odd, "Non-object")):
        with pytest.raises(ValueError, match=what):
            read(J.read_recovering, p)
    (tmp_path / "array").write_text(json.dumps([{"a": 5}, {"a": 6}], indent=1))
    assert values(read(J.read_array, tmp_path / "array")) == [5, 6]


def test_shards(spark, tmp_path):
    path = str(tmp_path / "s")
    J.write_shards(spark.range(25).select(F.col("id").alias("record_index")), path, size=10)
    assert J.read_record(spark, path, -1, 25, size=10).first()["record_index"] == 24
    with pytest.raises(IndexError):
        J.read_record(spark, path, 25, 25, size=10)
    there = spark.createDataFrame([(0, 10), (20, 25)], "start long, end long")
    assert [tuple(r) for r in J.missing_ranges(spark, there, 25, 10).collect()] == [(10, 20)]


def test_benchmark_formats(spark):
    s = "source_dataset_index long, "
    rows = spark.createDataFrame([(0, "i", "p", "x", ["a"], ["b", "c"]), (1, None, "p", "", ["d", "e"], ["f"])], s + "id string, prompt string, subset string, chosen array<string>, rejected array<string>")
    out = B.both_directions(B.grouped_prompts(rows)).orderBy("exchange", "dataset_index").collect()
    assert [(r["dataset_index"], r["prompt_id"], r["subset"], r["response_a"], r["response_b"], r["label"]) for r in out[:4]] == [(0, "i", "x", "a", "b", "response_a"), (1, "i", "x", "a", "c", "response_a"), (2, "1", "unknown", "d", "f", "response_a"), (3, "1", "unknown", "e", "f", "response_a")]
    assert (out[4]["response_a"], out[4]["label"], len(out)) == ("b", "response_b", 8)
    assert B.grouped_prompts(rows, subsets=["unknown"], limit=1).count() == 2
    fails(B.grouped_prompts(rows.withColumn("rejected", F.array(F.lit(" ")))), "rejected")

    c = "array<struct<constraint string>>"
    side = "struct<content string, unsatisfied_constraints array<string>>"
    row = (0, "1", None, " do it ", [("be brief.",)], [("rhyme",)], ("yes", []), ("no", ["x", "y"]))
    schema = s + f"id string, source string, instruction string, llm_constraints_used {c}, code_constraints_used {c}, chosen {side}, rejected {side}"
    got = B.constraint_pairs(spark.createDataFrame([row], schema)).first()
    assert (got["difficulty"], got["source"], got["instruction"]) == ("normal", "unknown", "do it") and got["rubric"].endswith("\n1. The response must be brief.\n2. The response must rhyme.")
    fails(B.constraint_pairs(spark.createDataFrame([(*row[:7], ("no", []))], schema)), "rejected_breaks_one")
    fails(B.constraint_pairs(spark.createDataFrame([row, (1, *row[1:])], schema)), "duplicate_id")

    schema = s + "domain string, language string, context array<struct<role string, content string>>, response1 string, response2 string, overall_preference int"
    talk = [("User", " hi "), ("assistant", "yo")]
    given = [(0, "Code", None, talk, "a", "b", -2), (1, "stem", "en", talk, "a", "b", 0), (2, "stem", "en", talk, None, "b", 1), (3, "stem", "en", talk, "a", "b", 3)]
    got = B.preference_pairs(spark.createDataFrame(given, schema)).orderBy("dataset_index").collect()
    assert [(r["dataset_index"], r["source_dataset_index"], r["label"], r["language"]) for r in got] == [(0, 0, "response_a", "unknown"), (1, 3, "response_b", "en")]
    assert got[0]["instruction"] == "Conversation context:\n\nUser:\nhi\n\nAssistant:\nyo"
    fails(B.preference_pairs(spark.createDataFrame([(0, "law", None, talk, "a", "b", 1)], schema)), "domain")
    fails(B.preference_pairs(spark.createDataFrame([(0, "stem", None, [("bot", "x")], "a", "b", 1)], schema)), "context")


def test_resume(spark, tmp_path):
    src, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    spark.createDataFrame([(1, "r"), (2, "r")], "k long, evaluation_id string").write.json(src)
    run = lambda: resume.ingest(spark, src, "k long, evaluation_id string", log, state, signature="r")
    assert run() == 1 and run() == 0
    spark.createDataFrame([(2, "r"), (3, "r")], "k long, evaluation_id string").write.mode("append").json(src)
    assert run() == 1
    rows = spark.read.parquet(log).drop("batch")
    assert rows.count() == 4 and sorted(r["k"] for r in resume.completed(rows, "k").collect()) == [1, 2, 3]
    fails(resume.completed(spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string"), "k"), "conflicting")
    assert sorted(r["k"] for r in resume.pending(spark.range(8).toDF("k"), resume.completed(rows, "k"), "k", 1, 2).collect()) == [5, 7]


TRACE = "Intro\n--- Analysis ---\n**Response A:**\n- Criterion 1 [Hard Rule]: Met.\nJustification: It  works.\n- Criterion 2 [Principle]: Partially Met. so so\n**Response B:**\n- Criterion 1 [Hard Rule]: Not Met. no\n--- Final Judgment ---\nResponse A\n"


def test_criteria():
    assert traces.criteria(TRACE) == [("A", 1, "hard rule", "met", ". Justification: It works."), ("A", 2, "principle", "partial", ". so so"), ("B", 1, "hard rule", "not_met", ". no")]
    assert traces.criteria("Criterion 1: a\nCriterion 1: b") == [("?", 1, "unknown", None, "b")] and traces.criteria(None) == []


def test_segments():
    parts = traces.segments(TRACE)
    assert "".join(TRACE[a:b] for a, b, _ in parts) == TRACE and [k for *_, k in parts] == ["gatekeeper", "criterion", "criterion", "criterion", "aggregation"]
    assert TRACE[slice(*parts[1][:2])].startswith("**Response A") and TRACE[slice(*parts[2][:2])].startswith("- Criterion 2")
    for bad in (None, "", TRACE + TRACE, TRACE.replace("Response B:", "Response A:"), TRACE.replace("**Response A", "- Criterion 9 [Principle]: x\n**Response A")):
        assert traces.segments(bad) is None


def pieces(text, **options):
    at = [0, *traces.cuts(text, **options), len(text)]
    return [text[a:b] for a, b in itertools.pairwise(at)]


def test_cuts():
    assert pieces('One. Two is 3.14, e.g. this. "Not. here." Wait?! Go... on J. Doe. End') == ["One. ", "Two is 3.14, e.g. this. ", '"Not. here." Wait?! ', "Go... on J. Doe. ", "End"]
    assert pieces("See `a. b` and $x. y$ and <b. c>. Ok. (In. side.) Out") == ["See `a. b` and $x. y$ and <b. c>. ", "Ok. ", "(In. side.) Out"]
    assert pieces("Choose response a. Then") == ["Choose response a. ", "Then"]
    assert pieces("a, b; c\\, d — e", soft=True) == ["a, ", "b; ", "c\\, d — ", "e"]
    assert traces.cuts(None) == []


def test_protected_sizes_are_least():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(8, 30)
        count = rng.randint(-(-n // 16), n // 4)
        forbidden = set(rng.sample(range(1, n), rng.randint(1, 4)))
        cost = lambda s: (sum(not 6 <= x <= 10 for x in s), sum(max(6 - x, 0, x - 10) for x in s), sum((x - 8) ** 2 for x in s), sum(abs(e - round((k + 1) * n / count)) for k, e in enumerate(itertools.accumulate(s))))  # noqa: E731, B023
        every = [s for s in itertools.product(range(4, 17), repeat=count - 1) if 4 <= n - sum(s) <= 16] if count <= 5 else None
        got = refine.protected_sizes(n, count, forbidden)
        if every is not None:
            fit = [(*s, n - sum(s)) for s in every if not forbidden & set(itertools.accumulate(s))]
            assert (got is None) == (not fit) and (got is None or cost(got) == min(map(cost, fit)))


def test_refinement_never_gets_worse():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.choice([16, 24, 40])
        base = list(range(8, n + 1, 8))
        e = refine.Evidence([rng.choice([-3.0, 2.0, 8.0]) for _ in range(n + 1)], [rng.choice([0, 0, 2]) for _ in range(n + 1)], [rng.random() < 0.3 for _ in range(n + 1)], {})
        best, taken = refine.refine_with_rescue(n, base, set(), e, refine.Weights())
        old, new = (refine.score(p, base, n, e, refine.Weights()) for p in (base, best))
        assert best[-1] == n and len(best) == len(base) and new.risky <= old.risky and new.words <= old.words
        assert taken == (best != base) and (not taken or new.words < old.words or new.total <= old.total + 1e-9)


@pytest.mark.parametrize("name", ["parse_criteria", "segment_trace", "sentence_boundaries", "refined_frontiers", "gumbel_topk"])
def test_rows_only_queries(spark, name):
    rows = catalogue.queries()[name](spark, SF)
    assert rows.count() > 0
    if name == "gumbel_topk":
        assert all(abs(r["s"] - 1) < 1e-5 for r in rows.groupBy("vec_id").agg(F.sum("p").alias("s")).collect())


def test_refined_frontiers_has_a_row_for_every_document(spark, tmp_path):
    from judgeloom.plans import trace_queries

    large = (1 << 53) + 1
    rows = [(large, " ".join(["word"] * 40)), (2, "too short"), (None, " ".join(["word"] * 40)), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = trace_queries.refined_frontiers(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["frontiers"] is None, r["taken"] is None) for r in out) == [(0, False, False), (2, True, True), (4, True, True), (5, True, True), (large, False, False)]
