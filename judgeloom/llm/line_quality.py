"""Quality of documents by a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line is described by its own features
and by those of the lines before and after it (``FEATURES``, each cut into
bins); the chain has a weight for each step between states and one for each
state of a first line.  Forward-backward gives the probability that a line is
good; a document's score is their mean, weighted by the lines' bytes.

Training: labels are of documents, so a line takes its document's.  Of the
labelled rows at most ``MAX_TRAINING`` are learned from, the first by a hash of
the id; ``SHARDS`` shares of them are fitted apart by Adam on the penalised
likelihood, each document counting as much as its lines' square root, and their
weights are averaged.  Shares are made by id and sorted, so that reruns agree.

The recursions run over all lines of a batch together: messages are products of
2 x 2 matrices, taken within blocks of lines side by side and then from block to
block.  At the start of a document the matrix has equal rows, which cuts the
chain.  Nothing but the sample is shuffled; scoring is one pass.

Results for odd inputs: null texts count as empty, and an empty text is one
empty line; long texts are read whole; null labels and null ids aren't learned
from; an id with several labels is good if one says so, and of its texts the smallest
is learned from; without good or bad rows everything scores 0.5; a null id is
never held out and stays null; repeated rows give a row each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packs as P
from .hashing import Bytes, joined

#: Labelled rows learned from at most.
MAX_TRAINING = 24_000
SHARDS, ROUNDS, RATE, PENALTY = 8, 150, 0.15, 0.02

_SYMBOLS, _STOPS, _CALLS = b"#$%&*|~^<>{}[]=+_/@\\", b".,;:", b"!?"
#: Kinds of bytes: 0 other, 1 a-z, 2 A-Z, 3 digits, 4 symbols, 5 stops, 6 calls,
#: 7 space, 8 first bytes of letters beyond ASCII, 9 further bytes.
_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2, 3
for _kind, _bytes in ((4, _SYMBOLS), (5, _STOPS), (6, _CALLS), (7, b" \t\r\x0b\x0c\n")):
    _KIND[list(_bytes)] = _kind
_KIND[0xC0:], _KIND[0x80:0xC0] = 8, 9

_SHARE = (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.6)
#: Features of a line, and where their bins end.
FEATURES: dict[str, tuple[float, ...]] = {
    "bytes": (0, 15, 40, 80, 160, 320, 640, 1280),
    "words": (0, 1, 3, 8, 16, 32, 64, 128),
    "word_length": (0, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 12),
    "capitals": _SHARE,
    "digits": _SHARE,
    "symbols": _SHARE,
    "stops": _SHARE,
    "calls": _SHARE,
    "beyond_ascii": _SHARE,
    "other": _SHARE,
    "first": (0, 1, 2, 3, 4, 5, 6, 8),
    "last": (0, 1, 2, 3, 4, 5, 6, 8),
    "distinct_words": (0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.97),
    "echoed_words": _SHARE,
    "copies": (1, 2, 4, 16),
    "place": (0, 1, 2, 3),
}
BINS = 9
_N = len(FEATURES)


@dataclass
class Lines:
    """All lines of some texts: bins (a row a line), bytes, first of each text."""

    codes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray


def described(texts: list[bytes]) -> Lines:
    """The lines of texts and the bins of their features."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    of_text = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.concatenate([[0], of_text[:-1]]))
    kinds = _KIND[raw]
    n = np.maximum(sizes, 1)

    def count(*which: int) -> np.ndarray:
        hit = np.concatenate([[0], np.cumsum(np.isin(kinds, which) if len(which) > 1 else kinds == which[0], dtype=np.int32)])
        return hit[ends] - hit[starts]

    upper, beyond, lower = count(2), count(8), count(1)
    letters = np.maximum(upper + lower + beyond, 1)
    inside = kinds != 7
    turn = np.diff(inside.astype(np.int8), prepend=0)
    word_at, word_end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    line_of = np.searchsorted(ends, word_at)
    words = np.bincount(line_of, minlength=len(ends))
    some = np.maximum(words, 1)
    of = Bytes(raw)
    hashes = of.ranges(word_at, word_end - word_at)
    same = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    echoed = np.bincount(line_of[1:][same], minlength=len(ends))
    _, one_each = np.unique(joined(hashes, line_of.astype(np.uint64)), return_index=True)
    distinct = np.bincount(line_of[one_each], minlength=len(ends))
    text_of = np.searchsorted(first, np.arange(len(ends)), "right") - 1
    _, back, copies = np.unique(joined(of.ranges(starts, sizes), text_of.astype(np.uint64)), return_inverse=True, return_counts=True)
    in_text = np.diff(np.concatenate([first, [len(ends)]]))[text_of]
    at = np.arange(len(ends)) - first[text_of]
    values = {
        "bytes": sizes,
        "words": words,
        "word_length": np.add(count(1, 2, 3, 4, 5, 6), beyond) / some,
        "capitals": upper / letters,
        "digits": count(3) / n,
        "symbols": count(4) / n,
        "stops": count(5) / n,
        "calls": count(6) / n,
        "beyond_ascii": beyond / letters,
        "other": count(0) / n,
        "first": np.where(sizes, kinds[starts], 7),
        "last": np.where(sizes, kinds[np.maximum(ends - 1, 0)], 7),
        "distinct_words": distinct / some,
        "echoed_words": echoed / some,
        "copies": copies[back],
        "place": np.where(in_text == 1, 0, np.where(at == 0, 1, np.where(at == in_text - 1, 2, 3))),
    }
    codes = np.stack([np.searchsorted(np.array(edges, float), values[name]) for name, edges in FEATURES.items()], axis=1)
    return Lines(codes.astype(np.uint8), sizes, first)


#: Weights: [which line, feature, bin] of a good line, then one for a good first
#: line, then one for each step (state before, state after; bad is 0).
SIZE = 3 * _N * BINS + 1 + 4


def _scores(w: np.ndarray, lines: Lines) -> np.ndarray:
    """How much the features of a line and its neighbours speak for good."""
    table = w[: 3 * _N * BINS].reshape(3, _N, BINS)
    out, ahead, behind = (sum(table[k, f][lines.codes[:, f]] for f in range(_N)) for k in range(3))
    inner = np.ones(len(out), bool)
    inner[lines.first] = False  # has a line before it
    out[1:] += np.where(inner[1:], ahead[:-1], 0)
    out[:-1] += np.where(inner[1:], behind[1:], 0)
    out[lines.first] += w[3 * _N * BINS]
    return np.clip(out, -30, 30)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices (4 rows of entries), the largest entry made 1."""
    out = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
    return out / out.max(axis=0)


def _messages(m: np.ndarray) -> np.ndarray:
    """(1, 1) times m[0] ... m[t] for every t, each made to sum to 1."""
    n = m.shape[1]
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    padded = np.tile(np.array([[1.0], [0.0], [0.0], [1.0]]), (1, blocks * width))
    padded[:, :n] = m
    grid = padded.reshape(4, blocks, width)
    products = np.empty_like(grid)
    products[:, :, 0] = grid[:, :, 0] / grid[:, :, 0].max(axis=0)
    for k in range(1, width):
        products[:, :, k] = _times(products[:, :, k - 1], grid[:, :, k])
    into = np.empty((2, blocks))
    bad = good = 0.5
    for b, (p, q, r, s) in enumerate(products[:, :, -1].T.tolist()):
        into[:, b] = bad, good
        bad, good = bad * p + good * r, bad * q + good * s
        bad, good = bad / (bad + good), good / (bad + good)
    bad, good = into[:, :, None]
    out = np.stack([bad * products[0] + good * products[2], bad * products[1] + good * products[3]]).reshape(2, -1)[:, :n]
    return out / out.sum(axis=0)


def _chain(w: np.ndarray, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(step matrices, probability of each line's states and their messages):
    returns P(good) by line and P(step) by line, zero at first lines."""
    good = np.exp(_scores(w, lines))
    steps = np.exp(w[-4:])[:, None] * np.stack([np.ones_like(good), good, np.ones_like(good), good])
    steps[:, lines.first] = np.stack([np.ones(len(lines.first)), good[lines.first]] * 2)
    ahead = _messages(steps)
    # behind a line: the product of all later matrices, by the transposed ones in reverse
    back = np.ones((2, len(good)))
    if len(good) > 1:
        back[:, :-1] = _messages(steps[[0, 2, 1, 3]][:, ::-1])[:, ::-1][:, 1:]
    both = ahead * back
    p = both[1] / both.sum(axis=0)
    before = np.concatenate([np.full((2, 1), 0.5), ahead[:, :-1]], axis=1)
    pairs = np.stack([before[i] * steps[2 * i + j] * back[j] for i in (0, 1) for j in (0, 1)])
    pairs /= pairs.sum(axis=0)
    pairs[:, lines.first] = 0
    return p, pairs


def line_probabilities(w: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, Lines]:
    """P(good) of every line of the texts."""
    lines = described(texts)
    return _chain(w, lines)[0], lines


def document_scores(w: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Their mean in each text, weighted by bytes (an empty line has one)."""
    if not texts:
        return np.zeros(0)
    p, lines = line_probabilities(w, texts)
    weight = np.maximum(lines.sizes, 1).astype(float)
    return np.clip(np.add.reduceat(p * weight, lines.first) / np.add.reduceat(weight, lines.first), 0, 1)


def gradient(w: np.ndarray, lines: Lines, good: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of all lines having their text's label, each text
    weighted by 1 / sqrt(lines)."""
    n = np.diff(np.concatenate([lines.first, [len(lines.sizes)]]))
    label, share = np.repeat(good, n), np.repeat(1 / np.sqrt(n), n)
    p, pairs = _chain(w, lines)
    off = (label - p) * share
    out = np.zeros(SIZE)
    inner = np.ones(len(off), bool)
    inner[lines.first] = False
    to = np.zeros((3, len(off)))  # what a line's features are answered by: itself, the next, the one before
    to[0] = off
    to[1, :-1] = np.where(inner[1:], off[1:], 0)
    to[2, 1:] = np.where(inner[1:], off[:-1], 0)
    for k in range(3):
        for f in range(_N):
            out[(k * _N + f) * BINS : (k * _N + f + 1) * BINS] = np.bincount(lines.codes[:, f], to[k], BINS)
    out[3 * _N * BINS] = off[lines.first].sum()
    for i in (0, 1):
        seen = np.where(inner & (label == i), share, 0).sum()  # labels don't change within a text
        out[-4 + 3 * i] = seen
    out[-4:] -= (pairs * share).sum(axis=1)
    return out


def fitted(lines: Lines, good: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by Adam, from zero."""
    w, m, v = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    for k in range(1, rounds + 1):
        g = gradient(w, lines, good) / len(good) - PENALTY * w / np.sqrt(len(good))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + RATE * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


def held_out(doc_id: Column) -> Column:
    """Rows that labels aren't learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from labelled rows that aren't held out; at most max_training
    labels are broadcast to the documents."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("good"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_training)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(sample), "_id")
    rows = rows.groupBy("_id").agg(F.min(F.struct("text", "good")).alias("r")).select("_id", "r.*")

    def fit(share: pd.DataFrame) -> pd.DataFrame:
        share = share.sort_values(["_id", "text"])
        good = share["good"].to_numpy(np.float64)
        w = fitted(described([bytes(t) for t in share["text"]]), good) if 0 < good.sum() < len(good) else np.zeros(SIZE)
        return pd.DataFrame({"w": [w.tolist()], "rows": [len(good) if w.any() else 0]})

    shares = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(SHARDS))).groupBy("_shard").applyInPandas(fit, "w array<double>, rows long").collect()
    shares = sorted((r["rows"], r["w"]) for r in shares if r["rows"])
    return np.average([w for _, w in shares], axis=0, weights=[n for n, _ in shares]) if shares else np.zeros(SIZE)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, texts in P.portions(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(document_scores(weights, texts))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
