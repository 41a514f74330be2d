"""The filter audit against every order worked out row by row."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from judgeloom.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, part string, failed string, n int, quality int, _id int, _text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", "ABC", 1, 0, 7, "t") for i, t, lang in rows], SCHEMA)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute(docs, labels):
    good, toxic = ({i for i, *ls in labels if i is not None and ls[k] == 1} for k in (0, 1))
    found = []
    for i, text, lang in docs:
        t = text or ""
        w = WORDS.findall(t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller)
        found.append((lang or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out, removed_by = [], {}
    for part in {f[0] for f in found}:
        for order in permutations("ABCDE"):
            left = [f for f in found if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                failing = sum(f[0] == part and x in f[1] for f in found)
                alone = sum(f[0] == part and f[1] == {x} for f in found)
                removed_by[part, x] = removed_by.get((part, x), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone)))
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def audited(docs, labels, **more):
    out = A.interactions(A.failed_counts(docs, labels, **more), "ABCDE")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "quality_lost", "toxic_lost", "shapley"]
    assert out.columns == columns
    return sorted(tuple(r) for r in out.collect())


def sample(n, seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "A#B", "é" * 300 + " x", "é" * 300 + " y"]
    for _ in range(n // 3):
        words = [rng.choice(["Alpha", "beta", "GAMMA", "δelta"]) + str(rng.randrange(rng.choice([20, 400]))) for _ in range(rng.choice([3, 99, 100, 101, 150, 900]))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", "", "$", "|"]))
    # of one length, equal in their first blocks
    texts += [texts[-1][:-2] + end for end in ("ab", "ac", "ad")]
    docs = [(rng.choice([None, *range(n // 2)]) if rng.random() < 0.3 else 1000 + i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(n)]
    labels = [(rng.choice([None, d[0]]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in docs for _ in range(rng.choice([0, 1, 2]))]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, labels = sample(150, seed)
    assert audited(table(spark, docs).repartition(5), labelled(spark, labels)) == brute(docs, labels)


def test_classes_of_different_texts(spark):
    """Hashes that tell nothing: only the texts do."""
    docs, labels = sample(120, 3)
    got = audited(table(spark, docs), labelled(spark, labels), block_hash=lambda block: F.lit(0).cast("long"))
    assert got == brute(docs, labels)


def test_full_map_lets_all_pass(spark):
    docs, labels = sample(90, 4)
    assert audited(table(spark, docs), labelled(spark, labels), max_bits=1 << 15, blocks=(0, 8)) == brute(docs, labels)


def test_one_text_in_a_third_of_rows(spark):
    docs = [(i, "same text" if i % 3 == 0 else f"own {i}", "en") for i in range(1500)]
    got = audited(table(spark, docs).repartition(20), labelled(spark, [(i, 1, 0) for i in range(0, 1500, 2)]))
    e_first = [r for r in got if r[1] == "EABCD"]
    assert [r[4] for r in e_first] == [499, 1001, 0, 0, 0] and e_first[0][7] == 249 and e_first[1][9] == 60 * 499 + 120 * 1001


def test_nothing(spark):
    none = labelled(spark, [])
    assert audited(table(spark, []), none) == []
    assert audited(table(spark, [(None, None, None)]), none) == brute([(None, None, None)], [])


def test_other_filters(spark):
    def two(text):
        return {"_t": F.length(text)}, {"x": F.col("_t") < 3, "y": text.contains("q")}

    docs = table(spark, [(1, "q", "en"), (2, "qqqq", "en"), (3, "q", "en"), (4, "fine", "en")])
    counts = A.failed_counts(docs, labelled(spark, [(1, 1, 1)]), filters=two, repeats="z")
    assert {("".join(sorted(r["failed"])), r["n"]) for r in counts.where("n > 0").collect()} == {("xy", 1), ("y", 1), ("xyz", 1), ("", 1)}
    assert A.interactions(counts, "xyz").count() == 18
    with pytest.raises(ValueError):
        A.failed_counts(docs, labelled(spark, []), filters=two, repeats="x")
