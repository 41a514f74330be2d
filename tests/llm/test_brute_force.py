"""Operators against plain programs on random small inputs."""

import hashlib
import random
import re

import numpy as np
import pytest

from judgeloom.llm import components, exact_dedup, hashing, jaccard_join, packs, pii, queries, substring_dedup, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string"
# The patterns as they are stated, for Python.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _ok(kind, x):
    digits = [int(c) for c in x if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def _base(text):
    return {k: [m.span() for m in re.finditer(p, text) if _ok(k, m[0])] for k, p in BASE.items()}


def _texts(n, rng):
    bits = ["a", "Z", "b.c", "@", "x@y.z", ".", "..", "+", "-", " ", "  ", "(", ")", "é", "𝔘", "%", "_", "0", "1", "12", "255", "256", "1.2.3.4", "001.2.3.4", "+1 22", "4111 1111 1111 1111", "4111-1111-1111-1111", "79927398713", "\n", "+49 (30) 1234-567"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(n)]


def test_base_spans(spark, tmp_path):
    texts = [*_texts(1500, random.Random(3)), "", None, "1" * 3000, "a." * 2000 + "@", "+1" + " " * 3000 + "2", "9" * 16 + " " + "1.1.1.1" * 50]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op5_personal_data(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        want = _base(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in want[k])
        r = out[i]
        assert [r[f"n_{k}"] for k in BASE] == [len(want[k]) for k in BASE], text
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("term:")) == listed


def test_many_spans_in_one_text(spark):
    """Counting places takes steps by the length, not its square."""
    n = 6000
    text = " ".join(f"é u{i}@m.org, +1 222 333 {i:04d};" for i in range(n))
    found = pii.find_personal_data(spark.createDataFrame([(1, text)], SCHEMA)).collect()[0]
    assert all([(s["start"], s["end"]) for s in found[k]] == _base(text)[k] and len(found[k]) == n for k in ("email", "phone"))
    clean = pii.sanitised(spark.createDataFrame([(1, text)], SCHEMA)).collect()[0]["clean_text"]
    assert clean == " ".join("é [email], [phone];" for _ in range(n))


def test_overlapping_spans_are_replaced_once(spark):
    text = "x 4111 1111 1111 1111 y +4111 1111 1111 1111@a.b z"
    want, at, out = sorted((s, e, k) for k, v in _base(text).items() for s, e in v), 0, ""
    for s, e, k in want:
        if s >= at:
            out += text[at:s] + f"[{k}]"
        at = max(at, e)
    assert pii.sanitised(spark.createDataFrame([(1, text)], SCHEMA)).collect()[0]["clean_text"] == out + text[at:]


def _distance_at_most_one(a, b):
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return None
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return 1 if a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] else None


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_edit_distance(seed):
    rng = random.Random(seed)
    word = lambda low, high: bytes(rng.choices(b"abc", k=rng.randint(low, high)))
    terms = sorted({word(3, 8) for _ in range(40)})
    words = sorted({word(1, 10) for _ in range(4000)} | set(terms))
    a = toxicity.Automaton(terms, 1)
    buf, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    who, what = a.run(buf, np.cumsum(lengths) - lengths, lengths)
    got = {words[w]: a.accepts[s][1] for w, s in zip(who.tolist(), what.tolist())}
    want = {}
    for w in words:
        near = [d for t in terms if (d := _distance_at_most_one(w, t)) is not None and (d == 0 or len(t) >= toxicity.FUZZY_LENGTH)]
        if near:
            want[w] = min(near)
    assert got == want


def test_urls_against_a_plain_search(spark):
    rng = random.Random(9)
    bits = [*(t for t, _ in url_filter.VOCABULARY), "/", ".", "-", "?", "#", "x", "9", "://", "http://", "EXAMPLE.org", "a.com", "/de/", "/fr/", "ü"]
    urls = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(1500)] + [None, "", "http://" + "free/" * 5000]
    rules = queries.RULES

    def plain(url):
        host, path = url_filter.host_and_path(url)
        fits = [(len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return max(fits)[2:]
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
        found = sum(w for t, w in url_filter.VOCABULARY if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low))
        return None, "block" if found >= url_filter.LIMIT else "allow"

    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(rows, rules).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}


def test_vocabulary_as_a_table(spark):
    words = spark.createDataFrame([("Alpha", 0.5), ("beta", 0.5), ("gamma", 1.0), (None, 1.0), ("", 1.0), ("beta", 0.25), ("rho", None)], "term string, weight double")
    rows = spark.createDataFrame(list(enumerate(["alpha", "alpha-beta", "ALPHA/alpha", "gamma", "rho", "betas alpha"])), "page_id long, url string")
    out = {r["page_id"]: (r["verdict"], r["strict_hits"], r["soft_hits"]) for r in url_filter.judge_urls(rows, [], words, limit=1).collect()}
    assert out == {0: ("allow", 0, 1), 1: ("block", 0, 2), 2: ("allow", 0, 1), 3: ("block", 1, 0), 4: ("allow", 0, 0), 5: ("allow", 0, 1)}
    assert url_filter.judge_urls(rows, [], []).where("verdict = 'block'").isEmpty()
    with pytest.raises(ValueError):
        url_filter.terms_of(words, 3)


def test_index_under_insertions_and_deletions(spark):
    """update_index against a dictionary of live members."""
    rng = random.Random(4)
    digest = [hashlib.sha256(bytes([k])).digest() for k in range(12)]
    schema = "digest binary, length long, keep_id long, keep_row long, rows long"
    live, model = spark.createDataFrame([], schema), {}
    for step in range(3):
        changes = [(rng.choice(digest), 1, rng.choice([None, *range(8)]), rng.randint(0, 3), rng.choice([1, 1, 1, 2, -1, -2])) for _ in range(80)]
        for d, n, i, r, k in sorted(changes, key=lambda c: c[4] < 0):
            if k > 0:
                model[d, i, r] = model.get((d, i, r), 0) + k
            elif (d, i, r) in model:
                model[d, i, r] += k
                if model[d, i, r] <= 0:
                    del model[d, i, r]
        live = packs.checkpointed(exact_dedup.update_index(live, spark.createDataFrame(changes, schema)))
        assert {(bytes(x["digest"]), x["keep_id"], x["keep_row"]): x["rows"] for x in live.collect()} == model
        want = {}
        for (d, i, r), k in model.items():
            best, n = want.get(d, ((False, 0, 0), 0))
            want[d] = (max(best, (i is not None, -1 if i is None else i, -r)), n + k)
        got = {bytes(x["digest"]): ((x["keep_id"] is not None, -1 if x["keep_id"] is None else x["keep_id"], -x["keep_row"]), x["rows"]) for x in exact_dedup.live_classes(live).collect()}
        assert got == {d: ((b[0], b[1] if b[0] else -1, b[2]), n) for d, (b, n) in want.items()}


def test_deleting_the_row_that_stays():
    index = exact_dedup.ExactIndex()
    d = hashlib.sha256(b"x").digest()
    index.insert(d, 1, (True, 1, 0))
    index.insert(d, 1, (True, 9, 0))
    assert index.keeps(d, 1) == (True, 9, 0)
    assert index.delete(d, 1, (True, 9, 0)) and index.keeps(d, 1) == (True, 1, 0)
    assert not index.delete(d, 1, (True, 9, 0))
    assert index.delete(d, 1, (True, 1, 0)) and index.keeps(d, 1) is None and index.size == 0
    with pytest.raises(TypeError):
        exact_dedup.ExactIndex(fold=True).delete(d, 1, (True, 1, 0))


def _swapped(n):
    """Two texts without a common word, whose letters follow the parity of bits."""
    return [" ".join(f"{i:04d}{'ab'[(i.bit_count() + k) % 2]}" for i in range(n)) for k in (0, 1)]


def test_patterns_that_cancel(spark):
    one, two = _swapped(2048)
    docs = spark.createDataFrame([(1, one), (2, two)], SCHEMA)
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeated_passages(docs).collect()}
    assert out == {1: 0, 2: 0}
    packed = [("".join("ab"[(i.bit_count() + k) % 2] for i in range(4096))).encode() for k in (0, 1)]
    for family in (0, 1):
        hashes = {int(hashing.Bytes(np.frombuffer(t, np.uint8)).ranges(np.array([0]), np.array([n]), family)[0]) for t in packed for n in (1000, 2048, 4096)}
        assert len(hashes) == 6
    bytes_ = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(packed)], SCHEMA)
    for length in (1024, 2048):
        count = {}
        for t in packed:
            for p in range(len(t) - length + 1):
                count[t[p : p + length]] = count.get(t[p : p + length], 0) + 1
        out = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeated_substrings(bytes_, length).collect()}
        for k, t in enumerate(packed):
            gone = np.zeros(len(t), bool)
            for p in range(len(t) - length + 1):
                if count[t[p : p + length]] > 1:
                    gone[p : p + length] = True
            assert out[k] == gone.sum()


def test_window_hashes_follow_content():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 3000).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 13, 20, 50):
        h, seen = hashing.windows(codes, width), {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(tuple(codes[i : i + width].tolist()), x) == x
        assert len(set(seen.values())) == len(seen) and len(h) == 3000 - width + 1


@pytest.mark.parametrize("width", range(1, 17))
def test_hashes_of_short_ranges(width):
    buf = np.frombuffer(b"abcabcabdabcabcabcabdabc" * 5 + b"ab", np.uint8)
    h, seen = hashing.Bytes(buf).every(width), {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(buf[i : i + width].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen) and len(h) == len(buf) - width + 1


def test_requests_follow_the_input(spark):
    """Rows of an exchange: as many as groups times buckets, for any input."""
    rng = random.Random(2)
    text = lambda: " ".join(f"{rng.getrandbits(32):08x}" for _ in range(2000))

    def rows(n):
        docs = spark.createDataFrame([(i, text()) for i in range(n)], SCHEMA).coalesce(1)
        p = packs.pack(docs, packs.words_text, pack_bytes=1 << 16, group_bytes=1 << 18)
        groups, n_packs = p.select("group_id").distinct().count(), p.count()
        buckets = -(-p.agg({"n_bytes": "sum"}).first()[0] // (1 << 18))

        def ask(pack):
            w = substring_dedup._Words(pack, 50)
            return packs.requests(0, buckets, np.unique(w.windows(50)))

        asked = packs.requested(p, buckets, ask)
        assert asked.count() <= groups * buckets and groups <= n_packs
        return groups

    assert rows(40) <= rows(80) <= 2 * rows(40) + 2


def _union(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_components_of_hubs_and_chains(spark, broadcast_rows):
    rng = random.Random(7)
    links = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(2000, 2040)] + [(rng.randrange(2100, 2400), rng.randrange(2100, 2400)) for _ in range(200)]
    want = _union(2400, links)
    edges = spark.createDataFrame(links, "a long, b long")
    out = {r["id"]: r["component"] for r in components.components(edges, broadcast_rows=broadcast_rows).collect()}
    assert out == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_across_many_small_blocks(spark, monkeypatch, seed):
    """Templates that all share tokens, chains of near copies and hot groups, in
    blocks of a few documents, so that links across blocks have to be found."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 3)
    monkeypatch.setattr(jaccard_join, "QUERIES", 4)
    monkeypatch.setattr(packs, "heavy_at", lambda n: 8)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    texts = []
    for _ in range(4):
        base = [word() for _ in range(60)]
        for _ in range(24):  # some far enough apart not to be linked, some linked through others
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                own[rng.randrange(60)] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(60)]
    for k in range(12):
        chain[5 * k % 60] = word()
        texts.append(" ".join(chain))
    template = [word() for _ in range(45)]
    texts += [" ".join(template + [f"own{seed}x{i}x{j}" for j in range(rng.randint(8, 15))]) for i in range(30)]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _union(len(texts), links)
    assert 3 < len(set(want)) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(docs).collect()} == dict(enumerate(want))


def test_more_buckets_than_partitions(spark, monkeypatch):
    """Exchanges of large inputs, which are dealt to a partition a bucket."""
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(200)}" for _ in range(rng.randint(0, 150))) for _ in range(20)]
    docs = spark.createDataFrame([(i, base[i % 20] + (" tail" if i % 3 == 0 else "")) for i in range(60)], SCHEMA).repartition(6)
    run = lambda: [sorted(map(str, f(docs).collect())) for f in (substring_dedup.remove_repeated_passages, suffix_dedup.remove_repeated_substrings, jaccard_join.similar_components)]
    few = run()
    monkeypatch.setattr(packs, "bucket_count", lambda p: 11)
    assert run() == few
