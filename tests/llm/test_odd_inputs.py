"""Nulls, empty and long texts, repeated rows, ids that repeat, clashing names."""

import random

import pytest

from judgeloom.llm import decontaminate, exact_dedup, jaccard_join, mixing, pii, queries, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter

BPE = {"ranks": queries.RANKS, "version": queries.VERSION}
#: Columns named as the operators' own.
SCHEMA = "doc_id long, text string, source string, lang string, _row long, row long, size long, key string, component_id long, kept boolean, digest string, group_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, 3, "k", 4, True, "d", 5) for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


LETTERS = ["".join(random.Random(k).choices("abcdefgh", k=4)) for k in range(200)]


def letters(rng, n):
    return " ".join(rng.choices(LETTERS, k=n))


def near(text):
    return text + " tail"


@pytest.fixture(scope="module")
def base():
    return words(random.Random(8), 60)


def test_copies_by_row(spark, base):
    docs = table(spark, [(1, base, "a"), (1, base.upper(), "b"), (1, "other", "a"), (None, base, "a"), (None, "Other", "b"), (7, None, "a"), (7, "", "a"), (8, "", None)])
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and sorted(str(r["text"] or "").lower() for r in out.collect()) == sorted([base.lower(), "other", ""])
    groups = exact_dedup.exact_groups(docs)
    assert out.count() == groups.where("kept").count() and groups.count() == 8
    assert [r["doc_id"] for r in out.where("coalesce(text, '') = ''").collect()] == [8]


def test_copies_of_a_heavy_text(spark, base):
    docs = table(spark, [(i, base if i % 3 else f"own {i}", "a") for i in range(2400)])
    out = exact_dedup.exact_groups(docs)
    assert out.count() == 2400 and out.where("kept").count() == 801
    assert {r["keep_id"] for r in out.where("group_size > 1").collect()} == {2399} and out.where("group_size = 1600").count() == 1600
    left = jaccard_join.similar_components(docs.select("doc_id", "text"))
    assert {(r["n"], r["c"]) for r in left.groupBy("component_id").agg({"doc_id": "count"}).toDF("c", "n").where("n > 1").collect()} == {(1600, 1)}


def test_near_copies_by_row(spark, base):
    other = words(random.Random(9), 60)
    docs = table(spark, [(5, base, "a"), (3, near(base), "a"), (None, near(near(base)), "a"), (3, other, "a"), (9, near(other), "a"), (None, "short", "a"), (None, "short", "b"), (4, None, "a"), (4, "", "a"), (4, " ", "b")])
    out = jaccard_join.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["text"]) for r in out.collect()) == sorted([near(base), other, "short", "None", "", " "])


def test_rows_of_one_id_are_one_document(spark, base):
    other = words(random.Random(9), 60)
    docs = spark.createDataFrame([(1, base), (1, other), (2, near(base)), (3, near(other)), (None, near(near(base)))], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join.similar_components(docs).collect())
    assert out == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_passages_with_null_and_repeated_ids(spark, base):
    docs = table(spark, [(2, base, "a"), (2, "x " + base, "a"), (None, base + " y", "a"), (1, words(random.Random(1), 60), "a"), (3, base, "a"), (3, base, "a")])
    out = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeated_passages(docs).collect())
    assert out == [(0, 61, 60), (1, 60, 0), (2, 60, 0), (2, 61, 0), (3, 60, 60), (3, 60, 60)]


def test_substrings_with_repeated_ids(spark):
    long = "".join(random.Random(2).choices("abcdefgh", k=300))
    docs = table(spark, [(1, long, "a"), (1, long, "a"), (None, "x" + long, "a"), (2, "x" * 150, "a"), (3, "é" * 150, "a"), (4, None, "a")])
    out = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeated_substrings(docs).collect())
    assert out == [(0, 301, 300, 1), (1, 300, 300, 1), (1, 300, 300, 1), (2, 150, 0, 0), (3, 300, 300, 1), (4, 0, 0, 0)]


def test_very_long_texts_and_words(spark, base):
    rng = random.Random(5)
    long, word = words(rng, 400_000), "".join(rng.choices("abc", k=300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " z"), (3, word), (4, word + " " + base), (5, base)], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeated_passages(docs).collect()}
    assert out == {1: (400_000, 0), 2: (400_001, 400_000), 3: (1, 0), 4: (61, 0), 5: (60, 60)}
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(docs).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    found = suffix_dedup.remove_repeated_substrings(docs)
    assert {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in found.collect() if r["doc_id"] in (1, 3)} == {1: 0, 3: 0}


def test_overlaps_of_odd_tables(spark):
    item = " ".join(f"t{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (1, item), (2, "t3 t4 t5 t6 t7 t8 t9 t10 t11 t12 t13 t14 t15 other"), (None, "zz"), (3, "")], "item_id long, text string")
    rows = [(1, item, "s"), (1, item, "s"), (1, "clean", "s"), (None, item + " zz", "s"), (None, None, "s"), (2, "zz, clean " * 3, "s"), (3, "w " * 50_000 + item, "s")]
    docs = table(spark, rows)
    results = []
    for bound in (1000, 0):
        found = decontaminate.find_overlaps(docs, items, broadcast_grams=bound)
        results.append(sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], str(r["items"]), str([(s["start"], s["end"]) for s in r["spans"]])) for r in found.collect()))
        cut = decontaminate.remove_spans(docs, items, broadcast_grams=bound)
        assert cut.columns == docs.columns
        assert sorted(str(r["text"]) for r in cut.collect()) == sorted(["", "", "clean", "", "None", ", clean " * 3, "w " * 50_000])
        kept = decontaminate.remove_contaminated(docs, items, broadcast_grams=bound)
        assert sorted(str(r["text"])[:9] for r in kept.collect()) == sorted(["clean", "None", "w w w w w"])
        none = decontaminate.find_overlaps(docs, items.limit(0), broadcast_grams=bound)
        assert none.count() == len(rows) and none.where("n_hit > 0 or size(items) > 0").isEmpty()
        assert decontaminate.find_overlaps(docs.limit(0), items, broadcast_grams=bound).count() == 0
    assert results[0] == results[1]
    assert results[0][0] == (0, 0, 0, "[]", "[]") and results[0][1] == (0, 21, 21, "[1, 2]", "[(0, 21)]")


def test_mix_of_odd_tables(spark):
    docs = table(spark, [(None, "a b c", "s"), (None, "a b c", "s"), (1, "d " * 40, None), (1, "d " * 40, None), (2, None, "t"), (3, "", "t")])
    out = mixing.mix(docs, block=1)
    rows = sorted((r["doc_id"] or 0, str(r["source"]), r["size"], r["taken"]) for r in out.collect())
    assert [r[:3] for r in rows] == [(0, "s", 3), (0, "s", 3), (1, "None", 40), (1, "None", 40), (2, "t", 0), (3, "t", 0)]
    assert all(0 <= r[3] <= 2 * r[2] for r in rows) and rows == sorted((r["doc_id"] or 0, str(r["source"]), r["size"], r["taken"]) for r in mixing.mix(docs, block=1).collect())


def test_batches_with_odd_names(spark, tmp_path):
    docs = table(spark, [(1, "hello world", "a"), (1, "hello world", "a"), (2, None, None)])
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    r.commit("2024/01 %2F é=x", token_counts.delta(inserted=docs, **BPE))
    r.commit("empty", token_counts.delta(inserted=docs.limit(0), **BPE))
    want = {("a", 2, 4), (None, 1, 0)}
    for _ in range(2):
        assert {(x["source"], x["n_docs"], x["n_tokens"]) for x in r.totals().collect()} == want
        r.commit("2024/01 %2F é=x", token_counts.delta(inserted=docs, **BPE))
        r.commit("empty", token_counts.delta(inserted=docs, **BPE))
        r.compact()
    assert r.batches() == []
    r.drop()
    assert not (tmp_path / "r").exists()


def test_a_repeated_commit_that_dies(spark, tmp_path, monkeypatch):
    docs = table(spark, [(1, "hello world", "a")])
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    r.commit("one", token_counts.delta(inserted=docs, **BPE))
    want = set(map(tuple, r.totals().collect()))
    assert len(want) == 1

    def die(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(r, "_publish", die)
        r.commit("one", token_counts.delta(inserted=docs, **BPE))  # known: nothing to publish
    assert set(map(tuple, r.totals().collect())) == want
    r._publish("never-written", "batch=one")  # what is there stays
    assert set(map(tuple, r.totals().collect())) == want


def test_personal_data_of_odd_tables(spark):
    docs = table(spark, [(None, "a@b.c", "s"), (None, "a@b.c", "s"), (1, "a@b.c", "s"), (1, None, "s"), (2, "\n", "s")])
    out = sorted((r["doc_id"] or 0, len(r["email"])) for r in pii.find_personal_data(docs).collect())
    assert out == [(0, 1), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_urls_of_odd_tables(spark):
    schema = "page_id long, url string, host string, path string, rule string, verdict string"
    rows = [(None, "http://casino.net", "h", "p", "r", "v"), (1, None, "h", "p", "r", "v"), (1, "", "h", "p", "r", "v"), (1, "x" * 100_000 + "/xxx", "h", "p", "r", "v")]
    out = url_filter.judge_urls(spark.createDataFrame(rows, schema), queries.RULES)
    assert sorted((r["page_id"] or 0, r["host"], r["verdict"]) for r in out.collect()) == [(0, "casino.net", "block"), (1, "", "allow"), (1, "", "allow"), (1, "", "block")]
    assert url_filter.judge_urls(spark.createDataFrame([], schema), queries.RULES).count() == 0


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(1)
    rows = [(i, letters(rng, 12) + (" blorgh " if i % 3 == 0 else " ") + letters(rng, 5), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i, _, _ in rows] + [(None, 1, "x"), (7, None, "x"), (8, 0, "x"), (8, 0, "x")], "doc_id long, toxic int, text string")
    docs = table(spark, [*rows, (None, "you blorgh", "s"), (None, None, "s"), (7, letters(rng, 100_000) + " blorgh", "s")])
    lexicon = toxicity.learn(docs, labels)
    out = toxicity.score(docs, lexicon)
    assert out.count() == len(rows) + 3 and out.where("doc_id is null and score >= 0.7").count() == 1
    left = toxicity.drop_toxic(docs, lexicon)
    assert left.columns == docs.columns and left.count() == 201
    assert toxicity.score(docs.limit(0), lexicon).count() == 0 and toxicity.learn(docs.limit(0), labels).words == []


def test_long_lists_of_terms_are_kept_whole(spark):
    """More toxic words than any fixed number: all are found."""
    rng = random.Random(6)
    names = ["".join(rng.choices("bcdfgklmprstz", k=3)) + "".join(rng.choices("aeiou", k=1)) + "".join(rng.choices("bcdfgklmprstz", k=4)) for _ in range(350)]
    rows = [(k * 1000 + j, f"{letters(rng, 3)} {name} {letters(rng, 3)}", "s") for k, name in enumerate(names) for j in range(40)]
    rows += [(900_000 + i, letters(rng, 8), "s") for i in range(20_000)]
    labels = spark.createDataFrame([(i, int(i < 900_000)) for i, _, _ in rows], "doc_id long, toxic int")
    docs = table(spark, rows)
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    assert found.where("doc_id < 900000 and score < 0.7").isEmpty() and found.where("doc_id >= 900000 and score >= 0.7").isEmpty()


def by_links(rows, share=0.75):
    """component_id of each row, by all pairs of rows."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            linked = sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])
            if linked or (rows[a][0] is not None and rows[a][0] == rows[b][0]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted((str(i), len(sets[k]), str(low.get(find(k)))) for k, (i, _) in enumerate(rows))


def linked(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(parts)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.similar_components(docs).collect())


def test_links_through_repeated_and_null_ids(spark, base):
    a, b = base, words(random.Random(30), 60)
    repeated = [(3, a), (5, a), (5, b), (7, b)]
    assert {c for _, _, c in linked(spark, repeated)} == {"3"} and linked(spark, repeated) == by_links(repeated)
    nulls = [(None, a), (None, near(a)), (4, a + " another end")]
    assert {c for _, _, c in linked(spark, nulls)} == {"4"} and linked(spark, nulls) == by_links(nulls)
    through = [(9, a), (None, a + " tail"), (2, " ".join(a.split()[4:]) + " tail of it"), (9, None), (8, ""), (None, ""), (None, "alone")]
    assert linked(spark, through) == by_links(through)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_random_ids(spark, seed):
    rng = random.Random(seed)
    bases = [words(rng, rng.choice([3, 5, 8, 30, 60])) for _ in range(25)]

    def varied(text):
        w = text.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        return " ".join(w)

    rows = [(rng.choice([None, rng.randrange(40)]) if rng.random() < 0.4 else 100 + k, rng.choice([None, "", varied(rng.choice(bases)), varied(rng.choice(bases)), rng.choice(bases)])) for k in range(150)]
    assert linked(spark, rows, 5) == by_links(rows)
