"""The plan of a trace's latent chunks: segments, budget, frontiers, markers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evidence, kernels, refine, traces

#: Ids of a text's tokens, and their first characters and ends, as lists or arrays.
Tokenizer = Callable[[str], tuple[Sequence[int], Sequence[tuple[int, int]]]]
PLAN = (
    "error string, n_tokens int, token_ends array<int>, counts array<int>, baselines array<int>, frontiers array<int>, kinds array<string>, accepted array<boolean>, "
    "moved int, cost_before double, cost_after double, risky_before int, risky_after int, broken_before int, broken_after int, marked array<long>"
)
_PIECES = re.compile(r"\s?\w+|\s?[^\w\s]|\s+")
#: Characters of texts that are planned together.
_TOGETHER = 1_000_000


class _Checksums(dict):
    def __missing__(self, piece: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[piece] = out = zlib.crc32(piece.encode("utf-8", "surrogatepass"))
        return out


_CHECKSUMS = _Checksums()


def piece_arrays(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``pieces`` as arrays; they cover the whole text."""
    found = _PIECES.findall(text)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    return np.fromiter(map(_CHECKSUMS.__getitem__, found), np.int64, len(found)), np.stack([np.concatenate([[0], ends[:-1]])[: len(found)], ends], axis=1)


def pieces(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Words and marks, each with the space before it; ids are checksums."""
    ids, offsets = piece_arrays(text)
    return ids.tolist(), list(map(tuple, offsets.tolist()))


def _lists(lengths: np.ndarray, there: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list for each row that is there, null for others."""
    offsets = np.zeros(len(there) + 1, np.int32)
    offsets[1:][there] = lengths
    return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32), mask=np.append(~there, False)), values)


def planned(texts: Sequence[str], tokenize: Tokenizer = piece_arrays, marker: int = -1, rules: evidence.Rules = evidence.Rules(), weights: refine.Weights = refine.Weights()) -> list[pa.Array]:
    """The columns of PLAN for some texts, whose segments are searched together."""
    errors: list[str | None] = []
    owner, starts, lengths, counts, ids, known = [], [], [], [], [], []
    base = 0
    for row, text in enumerate(texts):
        parts = traces.segments(text)
        errors.append(None if parts else "segments")
        if parts is None:
            continue
        tokens, offsets = tokenize(text)
        t = evidence.tokenized(text, offsets)
        edges = [*np.searchsorted(t.ends, [a for a, _, _ in parts], "right").tolist(), t.n]
        sizes = np.diff(edges).tolist()
        chunks = kernels.allocate(sizes)
        if chunks is None or sum(chunks) != -(-t.n // kernels.RATE):
            errors[row] = "budget"
            continue
        bad = np.array(evidence.fragments(t), float).reshape(-1, 3)
        known.append((*evidence.weighed(t, rules, parts), evidence.protected(t), bad + [base, base, 0]))
        owner += [row] * len(parts)
        starts += [base + edge for edge in edges[:-1]]
        lengths += sizes
        counts += chunks
        ids.append((row, base, np.asarray(tokens, np.int64)))
        base += t.n + 1  # a text has a cut more than tokens
    costs, risks, inside, kinds, forbidden, bad = map(np.concatenate, zip(*known, strict=True)) if known else [np.zeros(0, x) for x in (float, np.int8, bool, np.int8, bool)] + [np.zeros((0, 3))]
    first, stop = bad[:, 0].astype(np.int64), bad[:, 1].astype(np.int64)
    penalties = {}
    for size in np.unique(stop - first).tolist():
        penalties[size] = np.zeros(base)
        penalties[size][first[stop - first == size]] = bad[stop - first == size, 2]
    rows, begins = np.array(owner, np.int64), np.array(starts, np.int64)
    parts = refine.Parts(np.array(lengths, np.int64), np.array(counts, np.int64), begins, costs, risks, inside, forbidden, penalties)
    baseline, fits = parts.baselines()
    for row in rows[~fits].tolist():
        errors[row] = "protected"
    there = np.array([e is None for e in errors], bool)
    keep = there[rows]
    baseline, rows, begins, parts = baseline[keep[parts.segment]], rows[keep], begins[keep], parts.only(keep)
    best, taken = parts.refined(baseline, weights)
    ids = [x for x in ids if there[x[0]]]
    n_tokens = np.array([len(x) for _, _, x in ids], np.int64)
    # of each segment: where its text begins among all cuts, and among the tokens of planned texts
    texts_at = np.repeat(np.array([at for _, at, _ in ids], np.int64), np.bincount(rows, minlength=len(errors))[there])
    tokens_at = np.repeat(np.cumsum(n_tokens) - n_tokens, np.bincount(rows, minlength=len(errors))[there])
    shift, n_chunks = (begins - texts_at)[parts.segment], np.bincount(rows[parts.segment], minlength=len(errors))[there]
    n_parts = np.bincount(rows, minlength=len(errors))[there]
    total = lambda values: np.bincount(rows, values, minlength=len(errors))
    number = lambda values, kind: pa.array(values, kind, mask=~there)
    sums = {"moved": total(np.bincount(parts.segment[best != baseline], minlength=len(rows)))}
    for when, path in (("before", baseline), ("after", best)):
        s = parts.scores(path, baseline, weights)
        sums |= {f"cost_{when}": total(s.meaning), f"risky_{when}": total(s.risky), f"broken_{when}": total(s.words)}
    all_tokens = np.zeros(len(errors), np.int64)
    all_tokens[there] = n_tokens
    marked = np.insert(np.concatenate([np.zeros(0, np.int64), *(x for _, _, x in ids)]), tokens_at[parts.segment] + shift + best, marker)
    columns = {
        "error": pa.array(errors, pa.string()),
        "n_tokens": number(all_tokens, pa.int32()),
        "token_ends": _lists(n_parts, there, pa.array(begins - texts_at + parts.lengths, pa.int32())),
        "counts": _lists(n_parts, there, pa.array(parts.counts, pa.int32())),
        "baselines": _lists(n_chunks, there, pa.array(shift + baseline, pa.int32())),
        "frontiers": _lists(n_chunks, there, pa.array(shift + best, pa.int32())),
        "kinds": _lists(n_chunks, there, pa.array(evidence.KINDS, pa.string()).take(pa.array(kinds[parts.base[parts.segment] + best]))),
        "accepted": _lists(n_parts, there, pa.array(taken)),
        "marked": _lists(n_tokens + n_chunks, there, pa.array(marked)),
    }
    for name, values in sums.items():
        columns[name] = number(values, pa.float64()) if name.startswith("cost") else number(values.astype(np.int64), pa.int32())
    return [columns[f.split()[0]] for f in PLAN.split(", ")]


def plan(text: str, tokenize: Tokenizer = pieces, marker: int = -1, rules: evidence.Rules = evidence.Rules(), weights: refine.Weights = refine.Weights()) -> dict:
    """The plan of one trace; a trace without one has ``error`` alone."""
    found = {f.split()[0]: column[0].as_py() for f, column in zip(PLAN.split(", "), planned([text], tokenize, marker, rules, weights), strict=True)}
    return {"error": found["error"]} if found["error"] else found


def plans(docs: DataFrame, tokenize: Tokenizer = piece_arrays, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, error, ...): a plan for each text, in one pass.  A null text counts as empty, which has no segments."""
    names = ["doc_id", *(f.split()[0] for f in PLAN.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size = [], 0, 0
            for text in batch.column(1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= _TOGETHER or first + len(texts) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *planned(texts, tokenize)], names=names)
                    texts, first, size = [], first + len(texts), 0

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return traces.spread(source).mapInArrow(run, f"doc_id long, {PLAN}")
