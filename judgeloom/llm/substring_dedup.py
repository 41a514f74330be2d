"""Passages of words that an earlier document has: removal by difference cover.

A difference cover of the residues modulo PERIOD holds, for any two positions,
a shift under PERIOD that moves both onto cover positions.  So if two documents
share ``min_words`` words, an anchor of ``min_words - PERIOD + 1`` words starts
at a cover position in both, inside the shared passage.  Only anchors are
hashed for all of the corpus (19 % of the positions); each anchor that two
documents share is then extended: every window of min_words around it is hashed
to 96 bits and compared, and windows that start in a document with a smaller id
mark their words.  Whole copies of an earlier document are told by SHA-256
(128 bits of it) and aren't extended.

Results for odd inputs: a null or empty text has no words and a row with zeros
and an empty kept text; a null id sorts after all others and stays null; rows
with the same id never remove words of each other; repeated rows of another id
count as further documents; different texts under one id are one document's; an empty
table gives an empty table; other columns are ignored.  A long text needs some
twenty bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing as H
from . import packs as P

#: Perfect difference sets: every residue is a difference of two members.
COVERS = {31: (0, 1, 3, 8, 12, 18), 13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1), 1: (0,)}

ANCHORS, COPIES, WINDOWS = 0, 1, 2


def period_for(min_words: int) -> int:
    """The largest known period that leaves anchors of two fifths of the passage."""
    return max(p for p in COVERS if min_words - p + 1 >= max(1, 2 * min_words // 5))


class _Words:
    """Where the words of a pack are; its texts have single blanks."""

    def __init__(self, pack: P.Pack, min_words: int) -> None:
        self.pack = pack
        gaps = np.ones(len(pack.buf) + 1, bool)
        gaps[:-1] = pack.buf == 32
        first = np.zeros(len(pack.buf) + 1, bool)
        first[pack.starts[pack.sizes > 0]] = True
        first[1:] |= gaps[:-1]
        first &= ~gaps
        self.starts = np.flatnonzero(first)
        last = np.zeros(len(pack.buf) + 1, bool)
        last[pack.ends[pack.sizes > 0]] = True
        last |= gaps
        last[1:] &= ~gaps[:-1]
        last[0] = False
        self.ends = np.flatnonzero(last)
        self.doc = np.searchsorted(pack.ends, self.starts, "right")
        self.count = np.bincount(self.doc, minlength=len(pack.ids)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.min_words = min_words
        n = len(self.starts)
        self.place = np.arange(n) - self.first[self.doc] if n else np.zeros(0, np.int64)
        self.left = self.count[self.doc] - self.place if n else np.zeros(0, np.int64)
        self._codes: dict[int, np.ndarray] = {}

    def codes(self, family: int = 0) -> np.ndarray:
        """A code for each word."""
        if family not in self._codes:
            self._codes[family] = H.Bytes(self.pack.buf).ranges(self.starts, self.ends - self.starts, family)
        return self._codes[family]

    def windows(self, width: int, family: int = 0) -> np.ndarray:
        """A hash for each ``width`` words, by the first; some reach into the
        next document."""
        return H.windows(self.codes(family), width)


def _copies(w: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Long documents by digest: sorted distinct digests (key, check), their
    smallest id, and for every long document its digest's place and itself."""
    docs = np.flatnonzero(w.count >= w.min_words)
    digests = [hashlib.sha256(w.pack.buf[s:e]).digest()[:16] for s, e in zip(w.pack.starts[docs].tolist(), w.pack.ends[docs].tolist(), strict=True)]
    key, check = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T
    order = np.lexsort((check, key))
    key, check, docs = key[order], check[order], docs[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]) if len(key) else np.zeros(0, bool)
    edges = np.flatnonzero(new)
    smallest = np.minimum.reduceat(w.pack.ids[docs], edges) if len(edges) else np.zeros(0, np.int64)
    return key[edges], check[edges], smallest, np.cumsum(new) - 1, docs


def _anchors(w: _Words, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct anchors as twice the hash plus whether two documents of
    the pack have it; for every anchor its place there; where it is."""
    width = w.min_words - period + 1
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    at = np.flatnonzero(cover[w.place % period] & (w.left >= width) & (w.count[w.doc] >= w.min_words))
    h = w.windows(width)[at] | np.uint64(1)
    keys, where = np.unique(h, return_inverse=True)
    low = np.full(len(keys), len(w.count), np.int64)
    high = np.zeros(len(keys), np.int64)
    np.minimum.at(low, where, w.doc[at])
    np.maximum.at(high, where, w.doc[at])
    return keys ^ (low == high).astype(np.uint64), where, at



def _windows(w: _Words, at: np.ndarray):
    """Candidate windows: sorted distinct (key, check), the smallest id that
    has it, and for every window its place and itself."""
    key = w.windows(w.min_words, 0)[at]
    check = w.windows(w.min_words, 1)[at] >> np.uint64(32)
    order = np.lexsort((check, key))
    key, check, at = key[order], check[order], at[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]) if len(key) else np.zeros(0, bool)
    edges = np.flatnonzero(new)
    smallest = np.minimum.reduceat(w.pack.ids[w.doc[at]], edges) if len(edges) else np.zeros(0, np.int64)
    return key[edges], check[edges].astype(np.uint32), smallest, np.cumsum(new) - 1, at


def _answer(level: int, keys: np.ndarray, b: list, c: list) -> np.ndarray:
    """Anchors: 1 if two documents have it.  Copies, windows: 1 if a smaller id
    has the same content."""
    if level == ANCHORS:
        h = keys >> np.uint64(1)
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        edges = np.flatnonzero(new)
        times = np.add.reduceat(1 + (keys[order] & np.uint64(1)).astype(np.int64), edges)
        out = np.empty(len(keys), np.uint8)
        out[order] = (times >= 2)[np.cumsum(new) - 1]
        return out
    check = np.frombuffer(b"".join(b), np.uint64 if level == COPIES else np.uint32)
    ids = np.frombuffer(b"".join(c), np.int64)
    order = np.lexsort((check, keys))
    k, d = keys[order], check[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    smallest = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    out = np.empty(len(keys), np.uint8)
    out[order] = smallest[np.cumsum(new) - 1] < ids[order]
    return out


def _state(pack: P.Pack, min_words: int, period: int, n_buckets: int):
    """What is known after the first exchange: copies of earlier documents, and
    the candidate windows of all others."""
    w = _Words(pack, min_words)
    copy = np.zeros(len(pack.ids), bool)
    key, check, smallest, place, docs = _copies(w)
    earlier = P.replied(pack, COPIES, n_buckets, key).astype(bool)
    if len(docs):
        copy[docs] = earlier[place] | (smallest[place] < pack.ids[docs])
    keys, where, at = _anchors(w, period)
    shared = at[P.replied(pack, ANCHORS, n_buckets, keys)[where] > 0] if len(at) else at
    marks = np.zeros(len(w.starts) + period + 1, np.int32)
    marks[shared] = 1
    before = np.concatenate([[0], np.cumsum(marks)])
    n = len(w.starts)
    near = before[period : period + n] > before[:n]
    at = np.flatnonzero(near & (w.left >= min_words) & ~copy[w.doc]) if n else np.zeros(0, np.int64)
    return w, copy, _windows(w, at)


def remove_repeated_passages(docs: DataFrame, min_words: int = 50, period: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text without the words that
    windows of min_words cover whose words also start in a document with a
    smaller id.  Windows are judged on the input."""
    period = period or period_for(min_words)
    packs = P.pack(docs, P.words_text, id_col, text_col)
    n_buckets = P.bucket_count(packs)

    def ask_anchors(pack: P.Pack) -> Iterator[P.Request]:
        w = _Words(pack, min_words)
        key, check, smallest, _, _ = _copies(w)
        yield from P.requests(ANCHORS, n_buckets, _anchors(w, period)[0])
        yield from P.requests(COPIES, n_buckets, key, check, smallest)

    def ask_windows(pack: P.Pack) -> Iterator[P.Request]:
        key, check, smallest, _, _ = _state(pack, min_words, period, n_buckets)[2]
        return P.requests(WINDOWS, n_buckets, key, check, smallest)

    def remove(packs: Iterator[P.Pack]) -> Iterator[pa.RecordBatch]:
        for pack in packs:
            w, copy, (key, _, smallest, place, at) = _state(pack, min_words, period, n_buckets)
            gone = np.zeros(len(w.starts), bool)
            if len(at):
                earlier = P.replied(pack, WINDOWS, n_buckets, key).astype(bool)
                hit = at[earlier[place] | (smallest[place] < pack.ids[w.doc[at]])]
                steps = np.zeros(len(w.starts) + min_words + 1, np.int32)
                np.add.at(steps, hit, 1)
                np.add.at(steps, hit + min_words, -1)
                gone = np.cumsum(steps)[: len(w.starts)] > 0
            if len(w.doc):
                gone |= copy[w.doc]
            removed = np.bincount(w.doc[gone], minlength=len(pack.ids)).astype(np.int64)
            kept = []
            for i, text in enumerate(pack.texts()):
                if removed[i]:
                    s, n = w.first[i], w.count[i]
                    text = b" ".join([x for x, g in zip(text.split(b" "), gone[s : s + n].tolist(), strict=True) if not g])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([P.ids_out(pack.ids), pa.array(w.count), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    first = P.exchange(P.requested(packs, n_buckets, ask_anchors), n_buckets, _answer)
    second = P.exchange(P.requested(packs, n_buckets, ask_windows, first), n_buckets, _answer)
    return P.finished(packs, n_buckets, remove, "doc_id long, n_words long, n_removed long, kept_text string", first, second)
