"""Likeness of two token sequences by greedy matching of their tokens' vectors.

Each token meets the token of the other side that it is most alike (cosine);
precision is the mean of that over the candidate's tokens, recall over the
reference's, both weighted by the tokens' inverse document frequency among the
references; F1 is their harmonic mean.

Equal tokens are counted first, so a pair is matched by its distinct tokens,
a block of them against a block.  Tokens meet their vectors in a join that
Spark plans; a pair's tokens come together in one group, which is as large as
its two texts.

Results for odd inputs: a null side counts as empty; two empty sides are alike
(1), one empty side is not (0); a token without a vector, or with a zero one, is
like none but itself (1 where the other side has it too); a weight of zero on
either side gives 0; null tokens are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct tokens of one side that are compared at a time.
BLOCK = 2048

_SCHEMA = "id long, precision double, recall double, f1 double"


def frequencies(rows: DataFrame, reference: str = "reference") -> DataFrame:
    """(token, idf): ln((n + 1) / (df + 1)), df being the references of all n
    that have the token."""
    n = rows.count()
    tokens = rows.select(F.explode(F.array_distinct(reference)).alias("token")).where("token is not null")
    return tokens.groupBy("token").agg(F.log((F.lit(float(n)) + 1) / (F.count("*") + 1)).alias("idf"))


def best(own: np.ndarray, other: np.ndarray, own_tokens: list[str], other_tokens: list[str]) -> np.ndarray:
    """For each row of own, the largest cosine to a row of other (both of unit
    length or zero); 1 where the other side has the token itself."""
    out = np.full(len(own), -1.0 if len(other) else 0.0)
    for k in range(0, len(other), BLOCK):
        for s in range(0, len(own), BLOCK):
            out[s : s + BLOCK] = np.maximum(out[s : s + BLOCK], (own[s : s + BLOCK] @ other[k : k + BLOCK].T).max(axis=1))
    there = set(other_tokens)
    same = np.array([t in there for t in own_tokens], bool)
    return np.where(same, 1.0, out)


def _scored(table: pa.Table) -> pa.Table:
    c = {n: table.column(n).to_pylist() for n in ("id", "token", "side", "n", "idf", "vector")}
    width = max([0, *(len(v) for v in c["vector"] if v)])
    vectors = np.array([v if v else [0.0] * width for v in c["vector"]], float).reshape(len(c["token"]), width)
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-12)
    side, weight = np.array(c["side"]), np.array(c["n"], float) * np.array(c["idf"], float)
    order = np.argsort(np.array(c["token"], object), kind="stable")  # sums in one order, whatever the shuffle's
    places = [order[side[order] == s] for s in (0, 1)]
    shares = []
    for a, b in (places, places[::-1]):
        likeness = best(vectors[a], vectors[b], [c["token"][i] for i in a], [c["token"][i] for i in b])
        total = weight[a].sum()
        shares.append(float((likeness * weight[a]).sum() / total) if total > 0 and len(b) else 0.0)
    p, r = shares
    f1 = 2 * p * r / (p + r) if p + r > 0 else 0.0
    return pa.table({"id": pa.array(c["id"][:1], pa.int64()), "precision": [p], "recall": [r], "f1": [f1]})


def matched(rows: DataFrame, vectors: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """(id, precision, recall, f1) of rows(id, candidate, reference), arrays of
    tokens, by vectors(token, vector).  idf(token, idf) is that of these
    references unless given; a token that isn't there has the idf of none."""
    rows = rows.select(F.col("id").cast("long").alias("id"), *(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: t.isNotNull()).alias(c) for c in ("candidate", "reference")))
    idf = frequencies(rows) if idf is None else idf
    unseen = float(np.log(rows.count() + 1.0))
    sides = [rows.select("id", F.explode(c).alias("token"), F.lit(s).alias("side")) for s, c in enumerate(("candidate", "reference"))]
    counted = sides[0].unionByName(sides[1]).groupBy("id", "side", "token").agg(F.count("*").alias("n"))
    known = vectors.select("token", F.col("vector").cast("array<double>").alias("vector")).join(idf, "token", "full")
    told = counted.join(known, "token", "left").select("id", "side", "token", "n", F.coalesce("idf", F.lit(unseen)).alias("idf"), "vector")
    scored = told.groupBy("id").applyInArrow(_scored, _SCHEMA)
    alike = F.when((F.size("candidate") == 0) & (F.size("reference") == 0), 1.0).otherwise(0.0)
    return rows.join(scored, "id", "left").select("id", *(F.coalesce(c, alike).alias(c) for c in ("precision", "recall", "f1")))
