"""Benchmark decontamination by broadcast n-grams.

Items of a benchmark give windows of ``window`` normalised words (an item of
fewer words is one window).  Their hashes are broadcast, sorted, with the items'
text; document windows are looked up, hits verified by their words, and what
they cover is reported, or removed, or removes its document.  Texts move nowhere.

The broadcast is bounded: up to ``broadcast_grams`` windows, some 30 bytes and
the item's text each.  A larger benchmark's windows stay distributed: a bit map
of their hashes (of bounded size too) is broadcast instead, the document windows
that pass it are joined to the items' by hash and words, and the hits come back
by row number.  The documents are scanned once either way.

Words: A-Z in lower case, then runs of 0-9, a-z and all characters beyond
ASCII.  Results for odd inputs: null and empty texts have no words and aren't
contaminated; items without words have no windows; a null item id isn't listed
but its words are hit; repeated rows and items with the same id give one row
each and one id; rows are judged one by one, whatever their ids; an empty
benchmark hits nothing; other columns are ignored.  A long text needs some
twenty bytes of memory for each of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packs as P
from .substring_dedup import _Words

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FILTER_BITS = 20
#: Windows of items that are broadcast at most.
BROADCAST_GRAMS = 1_000_000
#: Bits of the map that stands for more of them.
MAP_BITS = (1 << 20, 1 << 28)

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "row long, doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<long>"


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEEP).split()


def _item_windows(texts: list[bytes], window: int) -> tuple[_Words, Iterator[tuple[int, np.ndarray]]]:
    """The items' words, and for each length of windows where they start."""
    w = _Words(P.Pack.of([0] * len(texts), texts), 1)
    size = np.minimum(window, w.count)
    return w, ((n, np.flatnonzero((size[w.doc] == n) & (w.left >= n))) for n in np.unique(size[size > 0]).tolist())


class NGrams:
    """Windows of a benchmark by length: sorted hashes, where their words are in
    the items' text, and whose they are."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int) -> None:
        self.ids = [item for item, _ in items]
        w, lengths = _item_windows([b" ".join(item_words(t.encode() if t is not None else None)) for _, t in items], window)
        self.text = w.pack.text
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n, at in lengths:
            h, check, item = w.windows(n)[at], w.windows(n, 1)[at], w.doc[at]
            order = np.lexsort((item, check, h))
            h, check, item, at = h[order], check[order], item[order], at[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (item[1:] != item[:-1])])
            h, item, at = h[new], item[new], at[new]
            sieve = np.zeros(1 << FILTER_BITS, bool)
            sieve[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.by_length[n] = (h, sieve, w.starts[at], w.ends[at + n - 1], item.astype(np.int32))

    def items_of(self, n: int, low: int, high: int, gram: bytes) -> list[int]:
        """Places of the items that have these words, among entries of one hash."""
        _, _, starts, ends, item = self.by_length[n]
        return [int(item[e]) for e in range(low, high) if self.text[starts[e] : ends[e]] == gram]


def _scan(grams: NGrams, pack: P.Pack) -> tuple[_Words, np.ndarray, list[set]]:
    """Words of the pack, which of them are hit, the items of each document."""
    w = _Words(pack, 1)
    steps = np.zeros(len(w.starts) + 1, np.int32)
    items: list[set] = [set() for _ in pack.ids]
    for n, (hashes, sieve, *_) in grams.by_length.items():
        at = np.flatnonzero(w.left >= n)
        if not len(at):
            continue
        h = w.windows(n)[at]
        maybe = np.flatnonzero(sieve[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        low, high = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
        for k in np.flatnonzero(high > low).tolist():
            i = int(at[maybe[k]])
            found = grams.items_of(n, int(low[k]), int(high[k]), pack.text[w.starts[i] : w.ends[i + n - 1]])
            if found:
                steps[i] += 1
                steps[i + n] -= 1
                items[w.doc[i]].update(x for x in map(grams.ids.__getitem__, found) if x is not None)
    return w, np.cumsum(steps)[:-1] > 0, items


def _spans(w: _Words, hit: np.ndarray, n_docs: int) -> list[list[dict]]:
    """Runs of hit words of each document, by their positions there."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    # a run may go on from one document into the next
    cuts = np.unique(np.concatenate([edge, w.first[w.count > 0], [len(hit)]]))
    cuts = cuts[cuts <= len(hit)]
    spans: list[list] = [[] for _ in range(n_docs)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hit[a]:
            d = int(w.doc[a])
            spans[d].append({"start": a - int(w.first[d]), "end": b - int(w.first[d])})
    return spans


def _found(rows: list, ids: list, n_words: np.ndarray, spans: list, items: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))], names=["row", "doc_id", "n_words", "spans", "items"])


def _scanner(grams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e, texts in P.portions(batch.column(2), _normal):
                w, hit, items = _scan(grams.value, P.Pack.of(ids[s:e], texts))
                yield _found(rows[s:e], ids[s:e], w.count, _spans(w, hit, e - s), [sorted(x) for x in items])

    return run


def _normal(text: bytes | None) -> bytes:
    return b" ".join(item_words(text))


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, int]:
    """(item, text) of the items that have words, and a number that neither they
    nor their windows exceed."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    return items.where(words > 0), items.agg(F.sum(words)).first()[0] or 0


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_grams: int = BROADCAST_GRAMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): spans are the runs of hit words
    as positions among the document's words, end exclusive."""
    items, n = _items(benchmark, item_col, item_text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = P.checkpointed(rows) if n > broadcast_grams else rows
    return _overlaps(rows, items, n, window, broadcast_grams).drop("row")


def _overlaps(rows: DataFrame, items: DataFrame, n_grams: int, window: int, broadcast_grams: int) -> DataFrame:
    """find_overlaps of (row, doc_id, text), with the row, which has to be
    numbered and stored beyond broadcast_grams."""
    rows = rows.select("row", "doc_id", "text")
    if n_grams <= broadcast_grams:
        grams = rows.sparkSession.sparkContext.broadcast(NGrams([tuple(r) for r in items.collect()], window))
        found = rows.mapInArrow(_scanner(grams), _FOUND)
    else:
        found = _exchanged(rows, items, n_grams, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def _exchanged(rows: DataFrame, items: DataFrame, n_grams: int, window: int) -> DataFrame:
    """Overlaps with a benchmark whose windows stay distributed."""

    def windows_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for s, _, texts in P.portions(batch.column(1).cast(pa.binary()), _normal):
                w, lengths = _item_windows(texts, window)
                for n, at in lengths:
                    grams = [w.pack.text[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at + n - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.int32()), pa.array(w.windows(n)[at].view(np.int64)), pa.array(grams, pa.binary()), pa.array([ids[s + d] for d in w.doc[at].tolist()], pa.int64())], names=["n", "hash", "gram", "item"])

    grams = P.checkpointed(items.mapInArrow(windows_of_items, "n int, hash long, gram binary, item long").distinct())
    lengths = sorted(r["n"] for r in grams.select("n").distinct().collect())  # window of them at most
    bits = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (16 * n_grams).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    flag = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {shift}) & 63 as int))")
    flags = grams.groupBy(F.shiftrightunsigned("hash", shift + 6).alias("at")).agg(F.bit_or(flag).alias("flags")).toArrow()
    known = np.zeros(bits // 64, np.int64)
    known[flags.column("at").to_numpy()] = flags.column("flags").to_numpy()
    sieve = rows.sparkSession.sparkContext.broadcast(known)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one for each window that may be an item's."""
        names = ["row", "doc_id", "n_words", "n", "place", "hash", "gram"]
        for batch in batches:
            row_ids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e, texts in P.portions(batch.column(2), _normal):
                w, none = _Words(P.Pack.of(ids[s:e], texts), 1), [None] * (e - s)
                yield pa.RecordBatch.from_arrays([pa.array(row_ids[s:e], pa.int64()), pa.array(ids[s:e], pa.int64()), pa.array(w.count), pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], names=names)
                for n in lengths:
                    at = np.flatnonzero(w.left >= n)
                    h = w.windows(n)[at] if len(at) else np.zeros(0, np.uint64)
                    p = (h >> np.uint64(shift)).astype(np.int64)
                    some = np.flatnonzero((sieve.value[p >> 6] >> (p & 63)) & 1)
                    at, h, none = at[some], h[some], [None] * len(some)
                    found = [w.pack.text[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at + n - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row_ids[s + d] for d in w.doc[at].tolist()], pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array([n] * len(at), pa.int32()), pa.array(w.place[at]), pa.array(h.view(np.int64)), pa.array(found, pa.binary())], names=names)

    passed = P.checkpointed(rows.mapInArrow(passing, "row long, doc_id long, n_words long, n int, place long, hash long, gram binary"))
    # Grams have numbers; items are looked up once for all rows that are hit by the
    # same grams, so that a gram of many items and rows isn't multiplied out.
    numbers_of = P.checkpointed(grams.select("hash", "gram").distinct().withColumn("number", F.monotonically_increasing_id()))
    numbered = grams.join(numbers_of, ["hash", "gram"]).select("number", "item")
    hits = passed.where("gram is not null").select("row", "n", "place", "hash", "gram").join(numbers_of, ["hash", "gram"])
    hits = P.checkpointed(hits.groupBy("row").agg(F.collect_set(F.struct("place", "n")).alias("hits"), F.array_sort(F.collect_set("number")).alias("numbers")))
    items_of = hits.select("numbers").distinct().select("numbers", F.explode("numbers").alias("number")).join(numbered, "number").groupBy("numbers").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.join(items_of, "numbers").select("row", "hits", "items")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for hits in batch.column("hits").to_pylist():
                own: list[dict] = []
                for h in sorted(hits or [], key=lambda h: h["place"]):
                    if own and h["place"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], h["place"] + h["n"])
                    else:
                        own.append({"start": h["place"], "end": h["place"] + h["n"]})
                spans.append(own)
            yield _found(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("n_words").to_numpy(), spans, [x or [] for x in batch.column("items").to_pylist()])

    return passed.where("gram is null").select("row", "doc_id", "n_words").join(hits, "row", "left").mapInArrow(merged, _FOUND)


def judged(overlaps: DataFrame, least_percent: int = 5) -> DataFrame:
    """overlaps with contaminated: some words are hit, and at least so many
    percent of all."""
    return overlaps.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= least_percent * F.col("n_words")))


def without_words(text: bytes | None, spans: list[dict]) -> bytes | None:
    """A text without the words that spans cover, and what stands between them."""
    if not spans:
        return text
    words, out, at = list(_WORD.finditer(text)), [], 0
    for s in spans:
        out.append(text[at : words[s["start"]].start()])
        at = words[s["end"] - 1].end()
    return b"".join([*out, text[at:]])


def _rewritten(docs: DataFrame, text_col: str, work: Callable[[pa.Array], tuple[np.ndarray, list | None]]) -> DataFrame:
    """docs, batch by batch: the rows that work keeps, with the texts it gives."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = work(batch.column(place).cast(pa.binary()))
            if texts is not None:
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, pa.binary()).cast(pa.string()))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_percent: int = 5, broadcast_grams: int = BROADCAST_GRAMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without contaminated rows, all columns unchanged.  Each row is judged
    by itself, whatever its id."""
    items, n = _items(benchmark, item_col, item_text)
    if n > broadcast_grams:
        rows, number = P.numbered(docs)
        texts = rows.select(F.col(number).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        bad = judged(_overlaps(texts, items, n, window, broadcast_grams), least_percent).where("contaminated")
        return P.without_rows(rows, number, bad)
    grams = docs.sparkSession.sparkContext.broadcast(NGrams([tuple(r) for r in items.collect()], window))

    def clean(column: pa.Array) -> tuple[np.ndarray, None]:
        keep = np.ones(len(column), bool)
        for s, e, texts in P.portions(column, _normal):
            w, hit, _ = _scan(grams.value, P.Pack.of([0] * (e - s), texts))
            n_hit = np.bincount(w.doc[hit], minlength=e - s)
            keep[s:e] = (n_hit == 0) | (100 * n_hit < least_percent * w.count)
        return keep, None

    return _rewritten(docs, text_col, clean)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_grams: int = BROADCAST_GRAMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, each text without the words that are hit (and what stands between
    words of one run); all other columns and texts unchanged."""
    items, n = _items(benchmark, item_col, item_text)
    if n > broadcast_grams:
        rows, number = P.numbered(docs)
        texts = rows.select(F.col(number).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        hit = _overlaps(texts, items, n, window, broadcast_grams).where("n_hit > 0").select(F.col("row").alias(f"{number}_hit"), F.col("spans").alias(f"{number}_spans"))
        both = rows.join(hit, F.col(number) == F.col(f"{number}_hit"), "left").drop(number, f"{number}_hit")
        columns = docs.columns

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch.schema.names.index(text_col)
                texts = [without_words(t, s or []) for t, s in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(f"{number}_spans").to_pylist(), strict=True)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, pa.binary()).cast(pa.string()))
                yield batch.select(columns)

        return both.mapInArrow(cut, docs.schema)
    grams = docs.sparkSession.sparkContext.broadcast(NGrams([tuple(r) for r in items.collect()], window))

    def cleaned(column: pa.Array) -> tuple[np.ndarray, list]:
        out = column.to_pylist()
        for s, e, texts in P.portions(column, _normal):
            w, hit, _ = _scan(grams.value, P.Pack.of([0] * (e - s), texts))
            for i, spans in enumerate(_spans(w, hit, e - s)):
                out[s + i] = without_words(out[s + i], spans)
        return np.ones(len(column), bool), out

    return _rewritten(docs, text_col, cleaned)
