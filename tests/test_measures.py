import random
import zipfile

import pytest
from pyspark.sql import functions as F

from judgeloom.operators import evidence, generate, intervals, kernels, nearest, refine, semantic
from judgeloom.sources import assets, stores

TRACE = (
    "--- Compliance Check ---\nIdentified Gatekeeper Criterion: 1.\n--- Analysis ---\n**Response A:**\n- Criterion 1 [Hard Rule]: Met.\nJustification: The response is short, and it says why. It cites `a + b` twice.\n"
    "- Criterion 2 [Principle]: Not Met.\nJustification: The answer ignores the question that was asked of it.\n**Response B:**\n- Criterion 1 [Hard Rule]: Not Met.\nJustification: It doesn't \"follow\" the rule, but tries to.\n--- Final Judgment ---\nResponse A is better.\n"
)


def test_spans_over_tokens(spark):
    rng = random.Random(3)
    tokens, spans = [], []
    for key in range(4):
        at = 0
        for _ in range(30):
            n = rng.randint(1, 5)
            tokens.append((key, at, at + n))
            at += n + rng.randint(0, 1)
        for i in range(12):
            a = rng.randint(0, at)
            spans.append((key, i, a, a + rng.randint(1, 25)))
    got = intervals.spans_over_tokens(spark.createDataFrame(tokens, "key long, start long, end long"), spark.createDataFrame(spans, "key long, span long, start long, end long"), "key", "span")
    want = {}
    for key, i, a, b in spans:
        mine = [t for t in tokens if t[0] == key]
        hit = [n for n, t in enumerate(mine) if t[2] > a and t[1] < b]
        want[key, i] = len(hit)
        if hit:
            row = got.where((F.col("key") == key) & (F.col("span") == i)).first() if i == 0 else None
            assert row is None or (row["lo"], row["hi"]) == (hit[0], hit[-1] + 1)
    assert {(r["key"], r["span"]): r["hi"] - r["lo"] for r in got.collect()} == want


def test_vocabulary_in_blocks_equals_one(spark):
    rng = random.Random(5)
    row = lambda i: (i, [rng.uniform(-1, 1) for _ in range(6)])
    vectors, words = spark.createDataFrame([row(i) for i in range(40)], "id long, v array<double>"), spark.createDataFrame([row(i) for i in range(50)], "word long, v array<double>")
    one, many = (sorted(map(tuple, nearest.cosine_top_k(vectors, words, 4, rows).collect())) for rows in (1000, 7))
    assert one == many and len(one) == 160


def test_two_values_of_an_even_split():
    for n in range(1, 80):
        for c in range(1, n + 1):
            sizes = kernels.balanced(n, c)
            off = [max(6 - s, 0, s - 10) for s in sizes]
            assert kernels.chunk_cost(n, c) == (sum(x > 0 for x in off), sum(off), sum((s - 8) ** 2 for s in sizes))


def test_evidence_cases():
    def kinds(text):
        _, offsets = semantic.pieces(text)
        return {text[: offsets[b - 1][1]]: (k, c) for b, (k, c) in enumerate(zip(*(lambda e: (e.kinds, e.costs))(evidence.weigh(text, offsets)), strict=True)) if 0 < b < len(offsets)}

    got = kinds("All is well. But the cat, not a dog, ran")
    assert got["All is well."] == ("sentence", -3.0)
    assert got["All is"] == ("word", 2.0)
    assert got["All is well. But the"] == ("word", 8.0)  # an article is bound to its noun
    assert got["All is well. But the cat,"] == ("phrase", 1.0)
    assert got["All is well. But the cat"] == ("detached_punctuation", 14.0)
    assert kinds("call `a + b` now")["call `a"] == ("compact_literal", 18.0)
    cut = evidence.weigh("abcd efg", [(0, 2), (2, 4), (4, 8)])
    assert cut.inside == [False, True, False, False] and cut.kinds[1] == "intra_lexeme" and cut.costs[1] == 12.0
    assert evidence.weigh("", []).costs == [2.0]


def test_protected_and_fragments():
    text = "- Criterion 12 [Hard Rule]: Met. There"
    _, offsets = semantic.pieces(text)
    names = [text[a:b] for a, b in offsets]
    assert names[:3] == ["-", " Criterion", " 12"]
    assert evidence.protected_cuts(text, offsets) == {2, 4, 5, 6, 9}
    short = "Met. There is"
    _, offsets = semantic.pieces("x y " + short + " one")
    assert evidence.fragment_costs("x y " + short + " one", offsets) == {}
    text = "Response A clearly explicitly is good"
    assert evidence.fragment_costs(text, semantic.pieces(text)[1]) == {(0, 4): 8.0, (0, 5): 4.0}


def test_semantic_plan_holds_its_bounds():
    found = semantic.plan(TRACE)
    assert found["error"] is None
    ids, offsets = semantic.pieces(TRACE)
    sizes = [b - a for a, b in zip([0, *found["frontiers"]], found["frontiers"], strict=False)]
    assert all(4 <= n <= 16 for n in sizes) and sum(sizes) == found["n_tokens"] == len(ids)
    assert len(sizes) == -(-len(ids) // 8) == sum(found["counts"])
    assert not evidence.protected_cuts(TRACE, offsets) & set(found["frontiers"]) - set(found["token_ends"])
    assert [x for x in found["marked"] if x != -1] == ids and found["marked"].count(-1) == len(sizes)
    assert found["risky_after"] <= found["risky_before"] and found["broken_after"] <= found["broken_before"]
    assert set(found["token_ends"]) <= set(found["frontiers"])
    assert semantic.plan("no trace")["error"] == "segments" and semantic.plan("")["error"] == "segments"


def test_semantic_plans_of_a_table(spark):
    rows = spark.createDataFrame([(1, TRACE, 0), (2, None, 0), (3, "", 0), (1, TRACE, 1), (None, TRACE, 0)], "doc_id long, text string, error int")
    got = [(r["doc_id"], r["error"]) for r in semantic.plans(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (1, None), (None, None), (2, "segments"), (3, "segments")], key=str)
    assert semantic.plans(rows.limit(0)).collect() == []


def _splits(length, count):
    if count == 0:
        return [[]] if length == 0 else []
    return [[n, *rest] for n in range(4, 17) if n <= length for rest in _splits(length - n, count - 1)]


def test_bounded_search_equals_enumeration():
    rng = random.Random(11)
    for _ in range(60):
        length, count = rng.randint(12, 34), rng.randint(2, 3)
        forbidden = {rng.randrange(1, length) for _ in range(rng.randint(1, 8))}

        def cost(sizes):
            ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
            off = [max(6 - n, 0, n - 10) for n in sizes]
            return sum(x > 0 for x in off), sum(off), sum((n - 8) ** 2 for n in sizes), sum(abs(e - round((i + 1) * length / count)) for i, e in enumerate(ends))

        legal = [s for s in _splits(length, count) if not forbidden & {sum(s[:i]) for i in range(1, count)}]
        got = refine.protected_sizes(length, count, forbidden)
        assert (got is None) == (not legal)
        if legal:
            assert got in legal and cost(got) == min(map(cost, legal))


def test_two_stores(spark):
    cache = spark.createDataFrame([(0, [1, 2, 3], [1, 3]), (1, [1, 2], [2]), (2, [1], [1]), (3, [1, 2], [2, 2]), (4, [1], [1])], "record_index long, explicit_ids array<int>, frontier_ends array<int>")
    labels = spark.createDataFrame([(0, [[0.5, 0.5], [1.0, 0.0]], [[1, 2], [1, 2]]), (1, [[0.0, 0.0]], [[1, 2]]), (2, [[float("nan")]], [[1]]), (3, [[1.0], [1.0]], [[1], [2]]), (5, [[1.0]], [[1]])], "record_index long, probs array<array<double>>, token_ids array<array<int>>")
    got = {r["record_index"]: r["fault"] for r in stores.paired(cache, labels).collect()}
    assert got == {0: None, 1: "no_mass", 2: "not_finite", 3: "frontiers", 4: "missing", 5: "missing"}
    stores.check_manifests({"num_records": 5, "use": "semantic"}, {"num_records": 5, "use": "semantic", "more": 1})
    with pytest.raises(ValueError, match="num_records"):
        stores.check_manifests({"num_records": 5}, {"num_records": 6})


def test_assets(tmp_path):
    manifest = {"a": {"repo": "r", "revision": "1", "path": "p"}, "b": {"repo": "s", "revision": "2", "type": "dataset", "path": "q"}}
    assert assets.wanted(manifest, ["b", "a", "b"]) == [("b", "s", "2", "dataset", "q"), ("a", "r", "1", "model", "p")]
    with pytest.raises(KeyError):
        assets.wanted(manifest, ["c"])
    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("pkg/x/1.txt", "one")
        z.writestr("other.txt", "no")
    assert [p.rsplit("/", 2)[1:] for p in assets.unpack(str(good), str(tmp_path / "out"), "pkg/")] == [["x", "1.txt"]]
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("pkg/ok.txt", "one")
        z.writestr("pkg/../../up.txt", "two")
    with pytest.raises(ValueError, match="Unsafe"):
        assets.unpack(str(bad), str(tmp_path / "out2"), "pkg/")
    assert not (tmp_path / "out2").exists()


def test_generators(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, prompt string")
    got = {r["id"]: r["output"] for r in generate.generate(rows, lambda: generate.stub, batch=1).collect()}
    assert got == {1: generate.stub(["a"])[0], 2: None, 3: generate.stub(["b"])[0]}


def test_samples_and_noise_do_not_depend_on_partitions(spark, tmp_path):
    from judgeloom.plans import catalogue

    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors.repartition(7, F.xxhash64("vec_id")).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("hash_sample", "gumbel_topk"):
        run = catalogue.queries()[name]
        one, other = (sorted(map(tuple, run(spark, d).collect())) for d in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one == other
    assert len(catalogue.queries()["hash_sample"](spark, str(tmp_path)).collect()) == 100
    sums = catalogue.queries()["gumbel_topk"](spark, str(tmp_path)).groupBy("vec_id").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == vectors.count() and all(abs(r["s"] - 1) < 1e-5 and r["n"] == 10 for r in sums)


def test_texts_with_nulls_and_odd_verdicts(spark):
    from judgeloom.functions import text as T

    rows = [(None, None), ("", None), ("Final Judgment: A\nFinal Judgement: b", "B"), ("**Final Judgment** I prefer response a over Response B", "A"), ("Response A wins", None), ("--- Final Judgment ---\nnone", None)]
    df = spark.createDataFrame(rows, "x string, want string").select(T.final_judgment(F.col("x")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    df = spark.createDataFrame([("a `b\nc` <d>",), (None,), ("",)], "x string").select(T.masked(F.col("x"), r"`[^`]*`|<[^<>\n]+>").alias("m"))
    assert [r["m"] for r in df.collect()] == ["a   \n      ", None, ""]


def test_mixed_evaluation_records(spark):
    from judgeloom.operators import layout

    rows = [(0, " p ", "Response B", None, None, None, None, None), (1, " ", "Response A", None, None, None, None, None), (2, "p", "tie", None, None, None, None, None), (3, None, None, "i", "r", "a", "b", "response_a"), (4, None, None, "i", None, "a", "", "response_a"), (5, None, None, "i", "r", "a", "b", "C")]
    df = spark.createDataFrame(rows, "eval_index int, problem string, cot_answer string, instruction string, rubric string, response_a string, response_b string, label string")
    got = {r["eval_index"]: (r["cot_answer"], r["subset"], r["exchange"], r["fault"]) for r in layout.eval_records(df, "J", "T").collect()}
    assert {k: v[3] for k, v in got.items()} == {0: None, 1: "problem", 2: "cot_answer", 3: None, 4: "missing rubric response_b", 5: "label"}
    assert got[0] == ("Response B", "unknown", False, None) and got[3][0] == "Response A"
    assert layout.eval_records(df.limit(0), "J", "T").collect() == []
