"""The pipeline as a whole, held against brute force and, for the mix, SQL."""

import random

import duckdb

import corpus_pipeline
from judgeloom.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = random.Random(11)
    words = ["w" + "abcdefgh"[i % 8] * (i // 8 + 2) for i in range(64)]
    rows = [(i, " ".join([*rng.choices(words, k=12), *(["blorgh"] if i % 3 == 0 else []), *rng.choices(words, k=5)]), f"s{i % 4}") for i in range(300)]
    texts = {i: t for i, t, _ in rows}
    rows += [(300 + k, texts[3 * k + 1].upper() if k % 2 else texts[3 * k + 1], "s1") for k in range(20)]  # equal but for case
    for k in range(20):  # one word more: near copies
        base = " ".join([texts[3 * k + 2], *rng.choices(words, k=30)])
        rows += [(400 + 2 * k, base, "s2"), (401 + 2 * k, base + " tail", "s3")]
    rows += [(500 + k, "lead " + " ".join(f"Item{k}, t{j}" for j in range(14)), "s0") for k in range(5)]
    return [*rows, (600, None, None), (601, "", "s1"), (602, " \n ", None)]


def _expected(rows, items):
    left = {i: t or "" for i, t, _ in rows if "blorgh" not in (t or "").lower()}
    last = {}
    for i, t in sorted(left.items()):
        last[t.lower()] = i
    left = {i: left[i] for i in last.values()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, label = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert links
    left = {i: t for i, t in left.items() if label[i] == i}

    def letters(t):
        return "".join(c if c.isalnum() else " " for c in t.lower()).split()

    grams = {tuple(w[k : k + 13]) for w in map(letters, items) for k in range(max(1, len(w) - 12)) if w}
    hit = {i for i, t in left.items() for w in [letters(t)] for k in range(len(w)) if tuple(w[k : k + 13]) in grams}
    assert hit
    return {i for i in left if i not in hit}


def test_pipeline(spark, tmp_path):
    rows = _rows()
    items = [" ".join(f"item{k} t{j}" for j in range(14)) for k in range(5)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = _expected(rows, items)
    assert {r["doc_id"] for r in out} == want and len(out) == len(want)

    con = duckdb.connect()
    con.execute("create table docs(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into docs values (?, ?, ?)", [r for r in rows if r[0] in want])
    mixed = con.execute(f"select doc_id, size, source_size, target, taken from ({queries.mix_sql('docs')})").fetchall()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out) == sorted(mixed)


def test_stages_keep_columns(spark, tmp_path):
    """Filtering stages return the columns of documents, on an empty table too."""
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
