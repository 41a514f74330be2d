"""One value in very many rows, and texts that hold very many of something."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from judgeloom.llm import components, decontaminate, mixing, pii
from judgeloom.sources.folders import shared_folder


def name(k):
    out = ""
    while k or not out:
        out, k = chr(97 + k % 26) + out, k // 26
    return out.rjust(6, "q")


def spans(found):
    return sorted((str(r["doc_id"]), [s["match"] for s in r["email"]], sorted(s["match"].lower() for s in r["term"])) for r in found.collect())


def test_many_entities_and_words_in_few_texts(spark):
    n = 4000
    text = " ".join(f"{name(k)} x{k}@a.bc" for k in range(n))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "nothing here")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["e"], r["t"]) for r in pii.find_personal_data(docs).select("doc_id", F.size("email").alias("e"), F.size("term").alias("t")).collect()}
    assert got == {1: (n, n), 2: (n, n), 3: (0, 0)} and time.time() - began < 60


def test_classes_of_entities_don_t_mix(spark):
    rows = [(1, "alpha beta a@b.cd e@f.gh"), (2, "alpha beta a@b.cd e@f.gh"), (3, "gamma delta i@j.kl"), (4, "gamma i@j.kl delta"), (5, "beta other"), *((k, f"filler{k}") for k in range(6, 40))]
    got = {r["doc_id"]: sorted(s["match"] for s in r["term"]) for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ["alpha"] and got[3] == got[4] == ["delta", "gamma"] and got[5] == []  # beta is elsewhere too


def test_more_texts_with_terms_than_are_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.choice(["", None, "a line that all have"])) for k in range(3000)] + [(5000 + k, f"secret{'abc'[k % 3]} mail{k % 3}@x.yz " + name(k)) for k in range(90)] + [(9000, "SecretB alone"), (None, "secretc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = spans(pii.find_personal_data(docs))
    assert any(t for _, _, t in want)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 2)
    assert spans(pii.find_personal_data(docs)) == want


def test_one_gram_in_many_items_and_documents(spark):
    licence = " ".join(f"lic{k}" for k in range(13))
    items = spark.createDataFrame([(k, f"own{k} {licence} end{k}") for k in range(400)] + [(1000 + k, t) for k, t in enumerate([None, "", "...", "short one"])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"d{k} {licence}") for k in range(300)] + [(500, "a short one here"), (501, f"own3 {licence}"), (502, None)], "doc_id long, text string").repartition(4)
    near, far = ({r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_overlaps(docs, items, broadcast_grams=most).collect()} for most in (1_000_000, 1))
    assert near == far and far[0] == (13, list(range(400))) and far[500] == (2, [1003]) and far[501] == (14, list(range(400))) and far[502] == (0, [])
    assert decontaminate._items(items, "item_id", "text")[0].count() == 401


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_id_spread_over_the_shards(spark, key):
    rng = random.Random(1)
    docs = spark.createDataFrame([(key, " ".join(["w"] * rng.randrange(1, 3000)), "s") for _ in range(600)], "doc_id long, text string, source string")
    out = mixing.mix(docs, shard_words=50_000).collect()
    shards = Counter(r["shard"] for r in out)
    assert len(out) == 600 and len(shards) >= 15 and max(shards.values()) < 100
    assert abs(sum(r["taken"] for r in out) - out[0]["target"]) < 0.05 * out[0]["target"]


def test_a_giant_component_beyond_the_broadcast(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 2500)] + [(5000 + 2 * k, 5001 + 2 * k) for k in range(600)], "a long, b long")
    out = components.components(edges, broadcast_rows=10)
    assert {(r["component"], r["count"]) for r in out.groupBy("component").count().collect()} == {(0, 2501)} | {(5000 + 2 * k, 2) for k in range(600)}


def made(spark, prefix):
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    found = fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)
    return {f.getPath().getName() for f in found if f.getPath().getName().startswith(prefix)}


def test_the_pipeline_leaves_no_numbered_copies_and_resumes(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    before = made(spark, "numbered")
    want = sorted(map(tuple, corpus_pipeline.run(spark, d).collect()))
    assert made(spark, "numbered") == before
    graph = corpus_pipeline.graph(spark, d, str(tmp_path))
    assert {what for _, what in graph.plan()} == {"run"}
    assert sorted(map(tuple, graph.run()["mixing"].collect())) == want
    again = corpus_pipeline.graph(spark, d, str(tmp_path))
    assert {what for _, what in again.plan()} == {"skip"} and sorted(map(tuple, again.result("mixing").collect())) == want
