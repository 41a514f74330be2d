"""Small tables with nulls, empty and long texts, ties, repeated rows, and
extra columns; held against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from judgeloom.llm import components, decontaminate, exact_dedup, jaccard_join, mixing, pii, queries, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter

BPE = {"ranks": queries.RANKS, "version": queries.VERSION}
SCHEMA = "doc_id long, text string, source string, lang string, row long, size long, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, "k") for i, t, s in rows], SCHEMA)


def sample():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 160))) for _ in range(30)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for k in range(30, 60):
        t = base[k % 12].split()
        for _ in range(k % 4):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t), "s0"))
    long = " ".join(rng.choices(words, k=30_000))
    return [*rows, (60, None, None), (61, "", "s1"), (62, "  \n\t ", "s1"), (63, base[3].upper(), "s2"), (64, long, "s3"), (65, "x " + long, "s3"), (66, "one two", "s1"), (67, "one two", "s1"), (68, "é" * 500, "s2")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_substring_dedup(spark):
    rows = sample()
    first, words = {}, {i: (t or "").encode().split() for i, t, _ in rows}
    for i, w in sorted(words.items()):
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), i)
    out = by_id(substring_dedup.remove_repeated_passages(table(spark, rows), min_words=20))
    assert len(out) == len(rows)
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < i:
                gone[p : p + 20] = [True] * 20
        assert (out[i]["n_words"], out[i]["n_removed"]) == (len(w), sum(gone))
        assert out[i]["kept_text"].encode() == b" ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("length", [12, 50, 200])
def test_suffix_dedup(spark, length):
    rows = sample()
    texts = {i: (t or "").encode() for i, t, _ in rows}
    count = Counter(b[p : p + length] for b in texts.values() for p in range(len(b) - length + 1))
    out = by_id(suffix_dedup.remove_repeated_substrings(table(spark, rows), length))
    for i, b in texts.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"]) == (len(b), sum(gone), spans)
        assert bytes(out[i]["kept"]) == bytes(x for x, g in zip(b, gone) if not g)


def test_exact_dedup(spark):
    rows = sample()
    low = {i: (t or "").encode().lower() for i, t, _ in rows}
    groups = {}
    for i, b in low.items():
        groups.setdefault(b, []).append(i)
    out = by_id(exact_dedup.exact_groups(table(spark, rows)))
    for i, b in low.items():
        g = groups[b]
        assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"], out[i]["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256(b).hexdigest())
    assert exact_dedup.drop_copies(table(spark, rows)).count() == len(groups)
    twice = table(spark, [(1, "a", "s"), (1, "a", "s"), (None, "a", "s")])
    assert exact_dedup.exact_groups(twice).where("kept").count() == 1


def test_cuckoo_filter_grows_and_deletes():
    index = exact_dedup.ExactIndex(10)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, d in enumerate(digests):
        index.insert(d, 1, (True, i, 0))
    assert index.resized and index.size == 3000 and all(index.find(d, 1) for d in digests)
    for i, d in enumerate(digests[:1500]):
        assert index.delete(d, 1, (True, i, 0))
    assert not any(index.find(d, 1) for d in digests[:1500]) and all(index.find(d, 1) for d in digests[1500:])
    assert not index.delete(digests[0], 1, (True, 0, 0))


def test_drop_copies_of_one_id_by_case(spark):
    docs = table(spark, [(1, "Some text", "s"), (1, "some TEXT", "s"), (None, "Other", "s"), (None, "oTHER", "s"), (1, "else", "s"), (2, None, "s"), (2, "", "s")])
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in out.collect()) == [(0, "other"), (1, "else"), (1, "some text"), (2, "")]


def test_jaccard_components(spark):
    rows = sample()
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    out = by_id(jaccard_join.similar_components(table(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == {i: (len(sets[i]), label[i]) for i in sets}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a long, b long")
    out = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert all(out[i] == 0 for i in range(101)) and out[201] == 200


def test_decontamination(spark):
    items = spark.createDataFrame([(1, " ".join("t%d" % i for i in range(20))), (2, "short item"), (3, None), (None, "zz yy"), (4, "")], "item_id long, text string")
    rows = [(1, "a b " + " ".join("T%d" % i for i in range(14)) + " c", "s"), (2, "Short, ITEM!", "s"), (3, None, "s"), (4, "nothing here", "s"), (5, "zz yy", "s"), (6, "", "s")]
    for bound in (1000, 0):
        out = by_id(decontaminate.judged(decontaminate.find_overlaps(table(spark, rows), items, broadcast_grams=bound)))
        assert [(out[i]["n_words"], out[i]["n_hit"], out[i]["items"], out[i]["contaminated"]) for i in range(1, 7)] == [(17, 14, [1], True), (2, 2, [2], True), (0, 0, [], False), (2, 0, [], False), (2, 2, [], True), (0, 0, [], False)]
        left = decontaminate.remove_contaminated(table(spark, rows), items, broadcast_grams=bound)
        assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 6]


def test_mixing(spark):
    rows = sample()
    out = mixing.mix(table(spark, rows), block=4).collect()
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    taken, target = Counter(), {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(abs(taken[s] - target[s]) <= 8 for s in target)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(table(spark, rows), block=4).collect()))
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0


def test_apportionment_is_sainte_lague(spark):
    from pyspark.sql import functions as F

    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 11, "e": 0}
    seats = Counter()
    for _ in range(97):
        best = max(votes, key=lambda p: (votes[p] / (2 * seats[p] + 1), p))
        seats[best] += 1
    df = spark.createDataFrame([("g", p, v) for p, v in votes.items()], "g string, p string, v long")
    out = {r["p"]: r["seats_won"] for r in mixing.apportion(df, ["g"], F.col("v"), F.lit(97), [F.col("p")]).collect()}
    assert out == {p: seats[p] for p in votes}


def test_decontamination_judges_rows_not_ids(spark):
    items = spark.createDataFrame([(1, " ".join("t%d" % i for i in range(20))), (2, "short item")], "item_id long, text string")
    rows = [(None, "short item", "s"), (None, "clean one", "s"), (7, "short item", "s"), (7, "clean two", "s"), (8, "short item", "s")]
    for bound in (1000, 0):
        left = decontaminate.remove_contaminated(table(spark, rows), items, broadcast_grams=bound)
        assert left.columns == table(spark, rows).columns
        assert sorted(r["text"] for r in left.collect()) == ["clean one", "clean two"]


def test_personal_data(spark):
    text = "é mail a@b.c_x@y.z ip 1.2.3.4.5 256.1.1.1 card 4111 1111 1111 1111, +1 (22) 333-44 555"
    out = by_id(pii.find_personal_data(table(spark, [(1, text, "s"), (2, None, "s"), (3, "", "s"), (4, "1" * 5000 + "a" * 5000 + "@", "s")])))
    found = {k: [text[s["start"] : s["end"]] for s in out[1][k]] for k in pii.KINDS}
    assert found == {"email": ["a@b.c", "_x@y.z"], "ip": ["1.2.3.4"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (22) 333-44 555"]}
    assert all(not out[i][k] for i in (2, 3, 4) for k in pii.KINDS)


def test_disclosing_terms(spark):
    rows = [(i, f"nothing ordinary here {i}", "s") for i in range(30)] + [(40 + i, "the ordinary Zanzibarian wrote from zed@mail.org again", "s") for i in range(3)]
    out = by_id(pii.find_personal_data(table(spark, rows)))
    assert "zanzibarian" in {s["match"].lower() for s in out[40]["term"]} and "ordinary" not in {s["match"] for s in out[40]["term"]}
    clean = by_id(pii.sanitised(table(spark, rows)))
    assert "[email]" in clean[40]["clean_text"] and "anzibarian" not in clean[40]["clean_text"]


def test_url_filter(spark):
    urls = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/17?q#x", "http://x.com/de/1", "http://x.net/free/pills", "http://x.net/freedom/pills", "no scheme casino", None, "http://casino-win.net", "https://b.org"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/")]
    out = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).orderBy("page_id").collect()]
    assert out == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"), ("x.com", "/de/1", "com/de/", "block"),
        ("x.net", "/free/pills", None, "block"), ("x.net", "/freedom/pills", None, "allow"), ("", "", None, "block"), ("", "", None, "allow"), ("casino-win.net", "", None, "block"), ("b.org", "", None, "allow")]


def test_disclosing_terms_beyond_base_spans(spark):
    far = " ".join(["ordinary"] * 20)
    rows = [(i, f"nothing ordinary here {i}", "s") for i in range(4000)] + [(5000 + i, f"Zanzibarian {far} wrote from zed@mail.org again", "s") for i in range(3)] + [(6000, "the zanzibarian alone", "s"), (6000, "the zanzibarian alone", "s"), (None, "ZANZIBARIAN", "s")]
    docs = table(spark, rows)
    found = pii.find_personal_data(docs)
    assert found.count() == len(rows)
    marked = sorted((r["doc_id"] or 0, [s["match"] for s in r["term"] if s["match"].lower() == "zanzibarian"]) for r in found.where("size(term) > 0").collect())
    assert marked == [(0, ["ZANZIBARIAN"]), *((5000 + i, ["Zanzibarian"]) for i in range(3)), (6000, ["zanzibarian"]), (6000, ["zanzibarian"])]
    clean = sorted((r["doc_id"] or 0, r["clean_text"]) for r in pii.sanitised(docs).collect())
    assert clean[0] == (0, "") and clean[-2:] == [(6000, "the  alone")] * 2 and len(clean) == 6
    several = pii.BROADCAST_ROWS
    try:
        pii.BROADCAST_ROWS = 0
        key = lambda r: (r["doc_id"] or 0, str(r))
        assert sorted(pii.find_personal_data(docs).collect(), key=key) == sorted(found.collect(), key=key)
    finally:
        pii.BROADCAST_ROWS = several


def test_levenshtein_automaton():
    import numpy as np

    a = toxicity.Automaton([b"stupid", b"scum"], 1)
    words = [b"stupid", b"stpid", b"stuupid", b"stupyd", b"stuyyd", b"scum", b"scam", b"tupid"]
    buf, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    who, what = a.run(buf, np.cumsum(lengths) - lengths, lengths)
    assert {words[w]: a.accepts[s] for w, s in zip(who, what)} == {b"stupid": (0, 0), b"stpid": (0, 1), b"stuupid": (0, 1), b"stupyd": (0, 1), b"scum": (1, 0), b"tupid": (0, 1)}


def test_levenshtein_stems():
    import numpy as np

    a = toxicity.Automaton([b"grump", b"scum"], 1, stems=True)
    words = [b"grump", b"grumpish", b"gruumpish", b"grmpishnesses", b"gtumpen", b"rumpish", b"gtunpen", b"scumming", b"scamming", b"g"]
    buf, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    who, what = a.run(buf, np.cumsum(lengths) - lengths, lengths)
    assert {words[w]: a.accepts[s] for w, s in zip(who, what)} == {b"grump": (0, 0), b"grumpish": (0, 0), b"gruumpish": (0, 1), b"grmpishnesses": (0, 1), b"gtumpen": (0, 1), b"rumpish": (0, 1), b"scumming": (1, 0)}


def test_misspelt_inflections(spark):
    rng = random.Random(2)
    words = ["w" + "abcdefgh"[i % 8] * (i // 8 + 2) for i in range(64)]
    for family, wrong in ((["blorghish", "blorghous", "blorghent", "blorghima"], "blirghous"), (["zorkaba", "zorkemo", "zorkiti", "zorkuku"], "zirkemo")):
        rows = [(i, " ".join([*rng.choices(words, k=12), *([family[i // 3 % 4]] if i % 3 == 0 else []), *rng.choices(words, k=5)]), "s") for i in range(600)]
        labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
        docs = table(spark, [*rows, (1000, f"you {wrong} there", "s"), (1001, f"you {family[1]} there", "s"), (1002, "you wander there", "s")])
        lexicon = toxicity.learn(docs, labels)
        assert lexicon.stems and not lexicon.words
        out = {i: r["score"] for i, r in by_id(toxicity.score(docs, lexicon)).items()}
        assert out[1000] >= 0.7 and out[1001] >= 0.7 and out[1002] == 0
        assert all((out[i] >= 0.7) == (i % 3 == 0) for i, _, _ in rows)


def test_toxicity(spark):
    rng = random.Random(1)
    words = ["w" + "abcdefgh"[i % 8] * (i // 8 + 2) for i in range(64)]
    rows = [(i, " ".join([*rng.choices(words, k=12), *(["blorgh"] if i % 3 == 0 else []), *rng.choices(words, k=5)]), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    docs = table(spark, [*rows, (1000, None, "s"), (1001, "", "s"), (1002, 'they said "blorgh" once', "s"), (1003, "you blorrgh", "s")])
    lexicon = toxicity.learn(docs, labels)
    out = {i: r["score"] for i, r in by_id(toxicity.score(docs, lexicon)).items()}
    assert all((out[i] >= 0.7) == (i % 3 == 0) for i, _, _ in rows)
    assert out[1000] == out[1001] == 0 and out[1002] < 0.7 <= out[1003]
    assert toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).where("score > 0").isEmpty()
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns


def test_token_rollup(spark, tmp_path):
    docs = table(spark, [(1, "hello world", "a"), (2, None, "a"), (3, "bye", None)])
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    for _ in range(2):
        r.commit("one", token_counts.delta(inserted=docs, **BPE))
    r.commit("two", token_counts.delta(deleted=docs.where("doc_id = 3"), revised=(docs.where("doc_id = 1"), table(spark, [(1, "hello", "a")])), **BPE))
    want = {("a", 2, 1)}
    assert {(x["source"], x["n_docs"], x["n_tokens"]) for x in r.totals().collect()} == want
    for _ in range(2):
        r.compact()
        r.commit("one", token_counts.delta(inserted=docs, **BPE))
        assert {(x["source"], x["n_docs"], x["n_tokens"]) for x in r.totals().collect()} == want
    assert r.batches() == [] and r._names("base=") == ["1"]


def test_token_rollup_survives_a_dead_writer(spark, tmp_path, monkeypatch):
    docs = table(spark, [(1, "hello world", "a"), (2, "bye", "b")])
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    r.commit("one", token_counts.delta(inserted=docs, **BPE))
    want = set(map(tuple, r.totals().collect()))

    def die(*_):
        raise RuntimeError

    with monkeypatch.context() as m:  # before a base is there
        m.setattr(r, "_publish", die)
        with pytest.raises(RuntimeError):
            r.compact()
        with pytest.raises(RuntimeError):
            r.commit("two", token_counts.delta(inserted=docs, **BPE))
    assert set(map(tuple, r.totals().collect())) == want and r.batches() == ["one"]
    with monkeypatch.context() as m:  # after that, before the batches are gone
        m.setattr(r, "clean", die)
        with pytest.raises(RuntimeError):
            r.compact()
    assert set(map(tuple, r.totals().collect())) == want
    r.commit("one", token_counts.delta(inserted=docs, **BPE))
    assert set(map(tuple, r.totals().collect())) == want
    r.clean()
    assert r._names("batch=") == [] and set(map(tuple, r.totals().collect())) == want


def test_token_counts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in queries.queries()["op4_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    enc, want = token_counts.encoding(queries.RANKS, token_counts.PATTERN), {}
    for r in docs.collect():
        n, t = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (n + 1, t + len(enc.encode_ordinary(r["text"] or "")))
    assert got == want


def test_empty_tables(spark):
    docs = table(spark, sample()).limit(0)
    for f in (substring_dedup.remove_repeated_passages, suffix_dedup.remove_repeated_substrings, exact_dedup.exact_groups, jaccard_join.similar_components, pii.find_personal_data):
        assert f(docs).count() == 0
