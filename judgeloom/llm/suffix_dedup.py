"""Repeated substrings by landmarks and fingerprints of prefixes.

This isn't the radix sort of suffixes by most-significant digits: that sends 77
times the input (README), so no suffix is sorted here.  What is kept of it are
its passes: windows of ``length`` bytes are told apart by longer and longer
prefixes, what has its prefix to itself leaves after each pass, and what is equal
after the last are exactly the repeated windows.

A pass doesn't hold single windows but runs of adjacent ones.  A window has a
landmark, the position in its first ANCHOR_SPAN whose next SAMPLE bytes hash
lowest, so equal windows have equal landmarks at equal distance.  A run is the
windows of one landmark within a block of distances.  Its *core* is the prefix
that all windows of a full block share; runs whose core occurs once end there.
Its *whole* is all bytes its windows touch; runs with equal wholes are repeated
entirely, and one of them goes on for all if others with this core do.  What is
left is cut into smaller blocks for the next pass: blocks of 80 distances, then
8, then 1, where core, whole and window are the same.  So the number of keys
follows the number of ends of repeated passages, not their length.  Core and
whole are told by 64-bit fingerprints of both together.

Texts count as their UTF-8 bytes.  Results for odd inputs: a null or empty text
has no bytes and a row with zeros; a null id stays null; repeated rows count as
further documents; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packs as P
from .hashing import Bytes, mix, sliding_min

#: Bytes that a landmark is chosen by.
SAMPLE = 16
#: Window starts hashed at a time; positions must fit into 24 bits.
PIECE = 2 << 20

NOT_REPEATED, REPEATED, GOES_ON, REPEATED_AND_GOES_ON = 0, 1, 2, 3


class _Plan:
    def __init__(self, length: int) -> None:
        self.length = length
        self.sample = min(SAMPLE, max(1, length // 4))
        self.span = max(1, length * 4 // 5)
        self.span = min(self.span, length - self.sample + 1)
        self.blocks = [b for b in (max(1, self.span // 2), 8) if b > 1 and b < length]
        self.blocks = sorted(set(self.blocks), reverse=True) + [1]


class _Runs:
    """Runs of windows: landmark, least and greatest distance, all in the
    positions of the pack's buffer."""

    def __init__(self, mark: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.mark, self.low, self.high = mark, low, high

    def cut(self, block: int) -> _Runs:
        """The runs by blocks of distances."""
        first, last = self.low // block, self.high // block
        times = last - first + 1
        of = np.repeat(np.arange(len(times)), times)
        b = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + first[of]
        return _Runs(self.mark[of], np.maximum(self.low[of], b * block), np.minimum(self.high[of], b * block + block - 1))

    def take(self, which: np.ndarray) -> _Runs:
        return _Runs(self.mark[which], self.low[which], self.high[which])


def _runs(pack: P.Pack, plan: _Plan) -> _Runs:
    """All windows of the pack, as runs of one landmark."""
    marks, lows, highs = [], [], []
    ends, n = pack.ends, len(pack.buf)
    doc_end = None
    for s in range(0, max(0, n - plan.length + 1), PIECE):
        e = min(s + PIECE, n - plan.length + 1)
        part = pack.buf[s : e + plan.length - 1]
        g = Bytes(part).every(plan.sample)
        g &= np.uint64(~((1 << 24) - 1) & ((1 << 64) - 1))
        g |= np.arange(len(g), dtype=np.uint64)
        mark = (sliding_min(g, plan.span)[: e - s] & np.uint64((1 << 24) - 1)).astype(np.int64) + s
        at = np.arange(s, e)
        doc_end = ends[np.searchsorted(ends, at, "right")]
        fits = at + plan.length <= doc_end
        at, mark, doc_end = at[fits], mark[fits], doc_end[fits]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1) | (doc_end[1:] != doc_end[:-1])]))
        last = np.concatenate([new[1:] - 1, [len(at) - 1]])
        marks.append(mark[new])
        highs.append(mark[new] - at[new])
        lows.append(mark[new] - at[last])
    none = np.zeros(0, np.int64)
    return _Runs(*(np.concatenate(x) if x else none for x in (marks, lows, highs)))


def _digits(runs: _Runs, block: int, plan: _Plan, text: Bytes) -> tuple[np.ndarray, np.ndarray]:
    b = runs.low // block
    core = text.ranges(runs.mark - b * block, np.full(len(b), plan.length - block + 1), 0)
    whole = text.ranges(runs.mark - runs.high, runs.high - runs.low + plan.length, 1)
    salt = np.uint64(0x9E3779B97F4A7C15)
    core = mix(core + b.astype(np.uint64) * salt + np.uint64(block))
    whole = mix(whole + (runs.low * 65536 + runs.high).astype(np.uint64) * salt) & np.uint64((1 << 64) - 2)
    return core, whole


def _combined(core: np.ndarray, whole: np.ndarray):
    """Sorted distinct digits, the lowest bit of whole set where the pack has
    them twice; for each run its place; the first run of each."""
    order = np.lexsort((whole, core))
    c, w = core[order], whole[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else np.zeros(0, bool)
    edges = np.flatnonzero(new)
    times = np.diff(np.concatenate([edges, [len(c)]]))
    place = np.empty(len(c), np.int64)
    place[order] = np.cumsum(new) - 1
    return c[edges], w[edges] | (times > 1).astype(np.uint64), place, order[edges]


def _answer(level: int, core: np.ndarray, b: list, c: list) -> np.ndarray:
    whole = np.frombuffer(b"".join(b), np.uint64)
    twice = (whole & np.uint64(1)).astype(np.int64)
    whole = whole >> np.uint64(1)
    order = np.lexsort((whole, core))
    k, w = core[order], whole[order]
    new_core = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_core | np.concatenate([[True], w[1:] != w[:-1]])
    edges = np.flatnonzero(new)
    times = np.add.reduceat(1 + twice[order], edges)
    group = np.cumsum(new_core)[edges] - 1
    kinds = np.bincount(group)
    alone = np.bincount(group, weights=times == 1)
    repeated = times >= 2
    goes_on = np.where(repeated, alone[group] > 0, kinds[group] > 1)
    of = np.cumsum(new) - 1
    code = np.where(repeated, REPEATED, NOT_REPEATED)[of]
    code[edges[goes_on]] += GOES_ON
    out = np.empty(len(core), np.uint8)
    out[order] = code
    return out


def _passes(pack: P.Pack, plan: _Plan, n_buckets: int, done: int):
    """Replays the passes that have been answered.  Gives the repeated runs and
    the digits that the next pass asks for (None after the last)."""
    text, runs, repeated = Bytes(pack.buf), _runs(pack, plan), []
    for level, block in enumerate(plan.blocks):
        runs = runs.cut(block)
        core, whole = _digits(runs, block, plan, text)
        keys, wholes, place, first = _combined(core, whole)
        if level == done:
            return repeated, (keys, wholes)
        code = P.replied(pack, level, n_buckets, keys)
        local = (wholes & np.uint64(1)).astype(bool)
        is_repeated = ((code & REPEATED) > 0) | local
        repeated.append(runs.take(is_repeated[place]))
        on = np.zeros(len(runs.mark), bool)
        on[first[(code & GOES_ON) > 0]] = True
        on |= ((code == GOES_ON) & ~local)[place]
        runs = runs.take(on)
    return repeated, None


def remove_repeated_substrings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's bytes without
    those that a string of ``length`` bytes covers which also starts anywhere
    else, in this or another document.  n_spans counts the maximal removed runs."""
    plan = _Plan(length)
    packs = P.pack(docs, P.raw_text, id_col, text_col)
    n_buckets = P.bucket_count(packs)

    def asking(level: int):
        def ask(pack: P.Pack) -> Iterator[P.Request]:
            keys, wholes = _passes(pack, plan, n_buckets, level)[1]
            return P.requests(level, n_buckets, keys, wholes)

        return ask

    def remove(packs: Iterator[P.Pack]) -> Iterator[pa.RecordBatch]:
        for pack in packs:
            steps = np.zeros(len(pack.buf) + 1, np.int32)
            for runs in _passes(pack, plan, n_buckets, len(plan.blocks))[0]:
                np.add.at(steps, runs.mark - runs.high, 1)
                np.add.at(steps, runs.mark - runs.low + length, -1)
            gone = np.cumsum(steps)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[pack.ends] - total[pack.starts]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = pack.starts[pack.sizes > 0]
            edge[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(edge)])
            n_spans = spans[pack.ends] - spans[pack.starts]
            kept = [pack.text[s:e] if not r else pack.buf[s:e][~gone[s:e]].tobytes() for s, e, r in zip(pack.starts.tolist(), pack.ends.tolist(), removed.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([P.ids_out(pack.ids), pa.array(pack.sizes), pa.array(removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    replies: list[DataFrame] = []
    for level in range(len(plan.blocks)):
        replies.append(P.exchange(P.requested(packs, n_buckets, asking(level), *replies), n_buckets, _answer))
    return P.finished(packs, n_buckets, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", *replies)
