"""Stores, records, settings, scores and vectors beyond what the SQL covers:
errors, odd values, small blocks."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from judgeloom.operators import blocks, evidence, intervals, layout, metrics, records, settings, vectors
from judgeloom.plans import catalogue
from judgeloom.sources import assets, json_files, registry, stores
from judgeloom.sources.folders import new_folder


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_named_split(spark, tmp_path):
    spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string").write.partitionBy("split").parquet(f"{tmp_path}/d")
    assert [r["id"] for r in json_files.read_split(spark, f"{tmp_path}/d", "test").collect()] == [2]
    with pytest.raises(KeyError):
        json_files.read_split(spark, f"{tmp_path}/d", "filtered")


def test_reports_and_configurations(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "a long, b string")
    json_files.write_report(rows, f"{tmp_path}/r")
    (line,) = [r["value"] for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert json.loads(line) == {"a": 1, "b": None}
    with pytest.raises(ValueError):
        json_files.write_report(rows.unionByName(rows), f"{tmp_path}/r")
    json_files.write_lines(rows.unionByName(rows), f"{tmp_path}/two")
    with pytest.raises(Exception):
        json_files.read_config(spark, f"{tmp_path}/two", "a long, b string")


def test_manifests(spark):
    a = json_files.manifest(spark, {"b": {"y": 1, "x": 2}, "a": None})
    assert [tuple(r) for r in a.collect()] == [("a", "null"), ("b", '{"x": 2, "y": 1}')]
    assert json_files.differing(a, a).isEmpty()
    assert [tuple(r) for r in json_files.differing(a, a.where("setting = 'a'")).collect()] == [("b", '{"x": 2, "y": 1}', None)]


def test_unknown_assets(spark):
    manifest = spark.createDataFrame([("m", "r", "v", "model", "p")], assets.ASSET)
    names = spark.createDataFrame([(0, "m"), (1, "m"), (2, "x")], "position long, name string")
    assert assets.asset_table(manifest, names.where("name = 'm'")).count() == 1
    fails(assets.asset_table(manifest, names), "Unknown asset: x")


def test_merged_parts_go(spark):
    parts = [new_folder(spark, "p") for _ in range(2)]
    for k, path in enumerate(parts):
        json_files.write_lines(spark.range(k, 10, 2), path)
    assert sorted(r["id"] for r in json_files.merge_parts(spark, parts, "id long", new_folder(spark, "m")).collect()) == list(range(10))
    with pytest.raises(Exception):
        spark.read.text(parts[0]).collect()


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_windows_by_blocks(spark, block):
    rng = random.Random(block)
    ids = rng.sample(range(200), 60)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 5)) for i in ids]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    by = {g: sorted((i, v) for i, x, v in rows if x == g) for g in ("a", "b", None)}
    sums = {r["id"]: r["s"] for r in blocks.running(df, "g", "id", F.col("v"), "s", block).collect()}
    nexts = {r["id"]: r["n"] for r in blocks.successor(df.select("id", "g"), "g", "id", "n", block).collect()}
    for members in by.values():
        for k, (i, _) in enumerate(members):
            assert sums[i] == sum(v for _, v in members[:k]) and nexts[i] == members[(k + 1) % len(members)][0]
    starts = rng.sample(range(200), 20)
    found = intervals.located(df.select("id"), spark.createDataFrame([(s,) for s in starts], "id long"), "id", "start", block)
    assert {r["id"]: r["start"] for r in found.collect()} == {i: max((s for s in starts if s <= i), default=None) for i in ids}


def test_requested_subsets(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a")], "eval_index long, subset string")
    assert records.parse_names(" b,a,, b ") == ["b", "a"] and records.parse_names(None) == []
    assert [r["eval_index"] for r in records.select_subsets(rows, ["a"], most=1).collect()] == [2]
    assert records.select_subsets(rows, []).count() == 3
    with pytest.raises(ValueError, match="'c'"):
        records.select_subsets(rows, ["a", "c"])
    with pytest.raises(ValueError):
        records.select_subsets(rows.limit(0), [])


def test_rubrics_must_be_there(spark):
    pairs = spark.createDataFrame([(1, "x"), (2, "y")], "dataset_index long, instruction string")
    rubrics = spark.createDataFrame([("1", "r")], "request_id string, rubric string")
    assert records.with_rubrics(pairs.where("dataset_index = 1"), rubrics).collect()[0]["rubric"] == "r"
    fails(records.with_rubrics(pairs, rubrics), "No rubric for request 2")
    assert records.with_rubrics(pairs.select("instruction").limit(1), spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), "r")], "request_id string, rubric string")).count() == 1


def test_training_records(spark):
    schema = "id long, instruction string, rubric string, response_a string, response_b string, judge string, winner string"
    row = lambda i, judge, winner="a", ask="i": (i, f" {ask} ", "r", "a", "b", judge, winner)
    rows = spark.createDataFrame([row(1, "why"), row(2, "why\nWinner: response  b\nmore"), row(3, "why, winner: A"), row(4, "Winner: Response A"), row(5, "x", ask=records.TASK), row(6, "why\r\nWinner: Response B\n"), row(7, "why\nWinner: tie")], schema)
    out = {r["id"]: (r["fault"], r["cot"], r["cot_answer"]) for r in records.training_records(rows, "id", "P").collect()}
    assert out == {1: (None, "why", "Response A"), 2: (None, "why\n\nmore", "Response B"), 3: ("winner lines: 0", None, None), 4: ("no reasoning", None, None), 5: ("task marker", None, None), 6: (None, "why", "Response B"), 7: ("winner label", None, None)}


def test_settings():
    assert settings.normalise_use(" SEMANTIC ") == "semantic"
    with pytest.raises(ValueError):
        settings.normalise_use("fixed")
    rules, weights = settings.chunk_policy('{"displacement": 6, "risk": 2.0}')
    assert (rules.risk, weights.displacement, weights.rescue) == (2.0, 6, 7)
    assert settings.chunk_policy("{}")[1].rescue == 5
    with pytest.raises(ValueError):
        settings.chunk_policy('{"nope": 1}')
    assert settings.training_steps(35612, 8, 4, 8, 3, 10, 100) == math.ceil(math.ceil(math.ceil(35612 / 8) / 4) / 8)
    for warm, decay, epochs in ((0, 10, 1), (10, 10, 1), (1, 10, 0)):
        with pytest.raises(ValueError):
            settings.training_steps(10, 1, 1, 1, epochs, warm, decay)


def test_registry(spark):
    assert set(registry.BUILDERS) == set(registry.BENCHMARKS)
    for call in (registry.builder, lambda n: registry.summarise(n, None)):
        with pytest.raises(KeyError):
            call("nope")


def test_published_frontiers(spark):
    docs = {r["doc_id"]: len((r["text"] or "").split(" ")) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = catalogue.queries()["seeded_frontiers"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 4 * len(docs)
    for r in out[:200]:
        digest = hashlib.blake2b(f"42:{r['doc_id']}:{r['view']}".encode(), digest_size=8).digest()
        assert r["frontier"] == 1 + int.from_bytes(digest, "little") % math.ceil(docs[r["doc_id"]] / 8)


def test_parses_change_cuts():
    text = "He said, because it did not rain today, they went."
    offsets = [(m, e) for m, e in _tokens(text)]
    place = lambda w: (text.index(w), text.index(w) + len(w))
    plain = evidence.weigh(text, offsets)
    arc = evidence.Arc(*place("not"), *place("rain"), "neg", (text.index("because"), text.index("today") + 5))
    told = evidence.weigh(text, offsets, arcs=[arc])
    cut = lambda w: next(i for i, (_, e) in enumerate(offsets) if e > text.index(w) + 1)
    assert told.risks[cut("rain")] == 2 and told.kinds[cut("because")] in ("clause", "phrase")
    assert told.kinds[cut("they")] == "clause" or plain.kinds[cut("they")] == "phrase"
    assert [a for a, b in zip(plain.costs, told.costs) if a != b]


def _tokens(text):
    at = 0
    for word in text.split(" "):
        yield at, at + len(word)
        at += len(word) + 1


def test_clauses_need_adjacent_words():
    W = evidence.Word
    # 0 root, 1 below 0, 2 below 1, 3 below 0, 4 below 1: the words below 1 have a gap
    words = [W(0, 2, 0, "ROOT", "VERB"), W(3, 5, 0, "advcl", "VERB"), W(6, 8, 1, "obj", "NOUN"), W(9, 11, 0, "conj", "AUX"), W(12, 14, 1, "obj", "NOUN")]
    assert evidence.clause_spans("aa bb cc dd ee", words) == [None, None, None, (9, 11), None]
    relative = [W(0, 2, 0, "ROOT", "VERB"), W(4, 6, 0, "relcl", "VERB")]
    assert evidence.clause_spans("aa, bb", relative) == [None, (4, 6)] and evidence.clause_spans("aa  bb", relative) == [None, None]


def test_bags_of_tokens(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices("abcd", k=rng.randint(0, 6)), rng.choices("abcd", k=rng.randint(0, 6))) for i in range(200)]
    out = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i long, a array<string>, b array<string>").select("i", metrics.bag_f1(F.col("a"), F.col("b")).alias("f")).collect()}
    for i, a, b in rows:
        want = float(a == b) if not a or not b else 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))
        assert out[i] == pytest.approx(want)


def test_a_scorer_can_be_given(spark):
    rows = spark.createDataFrame([(1, "k", ["a"], ["a"]), (2, "k", None, ["b"])], "doc_id long, k string, candidate array<string>, reference array<string>")
    one = metrics.semantic_scores(rows, "k", lambda r: r.withColumn("f1", F.lit(0.5))).collect()[0]
    assert (one["criteria"], one["covered"], one["score"]) == (2, 1, 0.25)
    assert metrics.semantic_scores(rows, "k").collect()[0]["score"] == 0.5


def test_projection_by_blocks(spark):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    words = spark.createDataFrame([(w, vec(), vec()) for w in range(40)], "word long, w array<double>, e array<double>")
    states = spark.createDataFrame([(i, vec()) for i in range(10)], "id long, h array<double>")
    for options in ({"top_k": 5}, {}, {"cosine": True, "temperature": 0.3}):
        one, many = (sorted((r["id"], r["rank"], r["word"], round(r["p"], 9)) for r in vectors.projected(states, words, block_rows=n, **options).collect()) for n in (1000, 7))
        assert one == many and len(one) == 10 * (options.get("top_k") or 40)
    p = vectors.projected(states, words, top_k=5)
    (w, e), got = ({r["word"]: r[c] for r in words.collect()} for c in ("w", "e")), vectors.weighted(p, words).where("id = 3").orderBy("dim").collect()
    h = states.where("id = 3").first()["h"]
    best = sorted(w, key=lambda k: -sum(a * b for a, b in zip(w[k], h)))[:5]
    z = [math.exp(sum(a * b for a, b in zip(w[k], h))) for k in best]
    assert [r["v"] for r in got] == pytest.approx([sum(x / sum(z) * e[k][d] for x, k in zip(z, best)) for d in range(6)])


def test_divergence(spark):
    z, q, at = [0.5, -1.0, 2.0, 0.0], [0.7, 0.1], [2, 0]
    row = spark.createDataFrame([(z, q, at)], "z array<double>, q array<double>, at array<int>")
    got = row.select(vectors.divergence(F.col("z"), F.col("q"), F.col("at"), 2.0).alias("kl")).first()["kl"]
    lse = math.log(sum(math.exp(x / 2) for x in z))
    assert got == pytest.approx(sum(p / 0.8 * (math.log(p / 0.8) - (z[i] / 2 - lse)) for p, i in zip(q, at)))


def test_packed_sequences(spark):
    rows = spark.createDataFrame([(i, list(range(i % 4))) for i in range(23)], "i long, v array<int>")
    packed = layout.packed(rows, "i", "v", 5)
    assert packed.count() == 5 and all(len(r["offsets"]) == len(r["records"]) + 1 and r["offsets"][-1] == len(r["values"]) for r in packed.collect())
    assert {r["record_index"]: list(r["t"]) for r in layout.unpacked(packed).collect()} == {i: list(range(i % 4)) for i in range(23)}


def test_overlays(spark):
    base = spark.createDataFrame([(1, 10, [0.1, 0.2], [4, 10]), (2, 7, [0.3], [7])], "k long, length int, latents array<double>, frontier_ends array<int>")
    over = spark.createDataFrame([(1, [0.5] * 3)], "k long, latents array<double>")
    out = {r["k"]: (r["latents"], r["frontier_ends"], r["overlaid"]) for r in stores.overlaid(base, over, "k").collect()}
    assert out == {1: ([0.5] * 3, [4, 7, 10], True), 2: ([0.3], [7], False)}
