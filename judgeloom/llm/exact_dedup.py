"""Exact duplicates through a cuckoo-filter index of live digests.

The index of a bucket of digests has two parts: a cuckoo filter of 16-bit
fingerprints, which can insert and delete, and the stored content (full digest,
length, live members), in small cells.  A miss in the filter proves a digest
new; a hit is verified against the content of its cell.  When an insertion
overflows, the filter is rebuilt at twice the size from the stored digests.

``exact_groups`` only inserts, so its entries fold their members into the one
that stays and a count: each task first runs an index over its own rows, so that
a text with copies in a third of all rows arrives once per task at its bucket's
index.  ``update_index`` serves a standing table of live members under
insertions and deletions; its buckets are of members, not of digests, so that a
text with very many copies is spread over all of them, and ``live_classes`` says
which member stays.

Texts are equal if identical after lower-casing A-Z.  Results for odd inputs: a
null text counts as empty; of rows with the same largest id one stays (the
first as stored); a null id is smaller than all others; an empty table gives an
empty table; other columns are ignored, and kept by ``drop_copies``, which goes
by row numbers, so that ids may repeat there or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packs as P

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS, KICKS = 4, 200
#: Digests in one index at most, in a task's own index and in a bucket's.
LOCAL_ENTRIES, BUCKET_ROWS = 100_000, 200_000


class Overflow(Exception):
    pass


class CuckooFilter:
    """Fingerprints of digests in cells of SLOTS, each in one of two cells."""

    def __init__(self, cells: int) -> None:
        self.cells = 1 << max(4, (cells - 1).bit_length())
        self.slots: list[list[int]] = [[] for _ in range(self.cells)]
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = 1 + int.from_bytes(digest[:2], "little") % 65535
        one = int.from_bytes(digest[2:10], "little") & (self.cells - 1)
        return print_, one, self._other(one, print_)

    def _other(self, cell: int, print_: int) -> int:
        return (cell ^ (print_ * 0x5BD1E995)) & (self.cells - 1)

    def __contains__(self, digest: bytes) -> bool:
        print_, one, two = self._places(digest)
        return print_ in self.slots[one] or print_ in self.slots[two]

    def insert(self, digest: bytes) -> None:
        """Raises Overflow, after moving fingerprints about; then the filter
        has to be rebuilt."""
        print_, one, two = self._places(digest)
        for cell in (one, two):
            if len(self.slots[cell]) < SLOTS:
                self.slots[cell].append(print_)
                self.size += 1
                return
        cell = one
        for kick in range(KICKS):
            k = (kick * 7 + print_) % SLOTS
            self.slots[cell][k], print_ = print_, self.slots[cell][k]
            cell = self._other(cell, print_)
            if len(self.slots[cell]) < SLOTS:
                self.slots[cell].append(print_)
                self.size += 1
                return
        raise Overflow

    def delete(self, digest: bytes) -> None:
        """Only for digests that have been inserted."""
        print_, one, two = self._places(digest)
        self.slots[one if print_ in self.slots[one] else two].remove(print_)
        self.size -= 1


class ExactIndex:
    """Live digests, each an entry [digest, length, members].  Members are
    (doc_id is there, doc_id, -row) with a count of rows each; the greatest one
    stays.  A folding index keeps that one only, with the count of all rows, and
    can't delete."""

    def __init__(self, expected: int = 1000, fold: bool = False) -> None:
        self.filter = CuckooFilter(expected // 3 + 1)
        self.content: dict[int, list[tuple[bytes, int, dict[tuple, int]]]] = {}
        self.size = 0
        self.resized = 0
        self.fold = fold

    def _cell(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:13], "little")

    def find(self, digest: bytes, length: int) -> dict[tuple, int] | None:
        """The members of a live digest."""
        if digest not in self.filter:
            return None
        for known, n, members in self.content.get(self._cell(digest), ()):
            if known == digest and n == length:
                return members
        return None

    def keeps(self, digest: bytes, length: int) -> tuple | None:
        members = self.find(digest, length)
        return max(members) if members else None

    def insert(self, digest: bytes, length: int, key: tuple, rows: int = 1) -> None:
        members = self.find(digest, length)
        if members is not None:
            if self.fold:
                ((other, n),) = members.items()
                members.clear()
                members[max(other, key)] = n + rows
            else:
                members[key] = members.get(key, 0) + rows
            return
        self.content.setdefault(self._cell(digest), []).append((digest, length, {key: rows}))
        self.size += 1
        try:
            self.filter.insert(digest)
        except Overflow:
            self._rebuild()

    def delete(self, digest: bytes, length: int, key: tuple, rows: int = 1) -> bool:
        """Takes a live member's rows off; a digest without members isn't live
        any more.  False if the member wasn't live."""
        if self.fold:
            raise TypeError("a folding index has no members to delete")
        members = self.find(digest, length)
        if members is None or key not in members:
            return False
        members[key] -= rows
        if members[key] <= 0:
            del members[key]
        if not members:
            cell = self.content[self._cell(digest)]
            cell[:] = [e for e in cell if (e[0], e[1]) != (digest, length)]
            if not any(e[0] == digest for e in cell):
                self.filter.delete(digest)
            self.size -= 1
        return True

    def _rebuild(self) -> None:
        cells = self.filter.cells
        while True:
            cells *= 2
            self.resized += 1
            self.filter = CuckooFilter(cells)
            try:
                for digest in {entry[0] for entry in self.entries()}:
                    self.filter.insert(digest)
                return
            except Overflow:
                continue

    def entries(self) -> Iterator[tuple[bytes, int, dict[tuple, int]]]:
        for cell in self.content.values():
            yield from cell


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of a text with A-Z in lower case; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER).cast("binary"), 256)


_ENTRIES = "digest binary, length long, keep_id long, keep_row long, rows long"
_NAMES = [x.split()[0] for x in _ENTRIES.split(", ")]
_TYPES = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _table(index: ExactIndex, kind=pa.RecordBatch):
    rows = [(d, n, k[1] if k[0] else None, -k[2], c) for d, n, members in index.entries() for k, c in members.items()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return kind.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _key(doc_id: int | None, row: int) -> tuple:
    return (doc_id is not None, doc_id or 0, -row)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = ExactIndex(fold=True)
    for batch in batches:
        for digest, n, doc_id, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            index.insert(digest, n, _key(doc_id, row))
            if index.size >= LOCAL_ENTRIES:
                yield _table(index)
                index = ExactIndex(fold=True)
    yield _table(index)


def _merged(table: pa.Table) -> pa.Table:
    index = ExactIndex(table.num_rows, fold=True)
    for digest, n, keep, row, rows in zip(*(table.column(x).to_pylist() for x in _NAMES), strict=True):
        index.insert(digest, n, _key(keep, row), rows)
    return _table(index, pa.Table)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row: of equal
    texts the row with the largest id stays."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _groups(rows).drop("row")


def _groups(docs: DataFrame) -> DataFrame:
    """exact_groups of (doc_id, text, row), with the row, whose number is unique."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = P.checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(text_digest(text)).alias("digest"), F.octet_length(text).cast("long").alias("length"), "row"))
    total = rows.count()
    n = max(P.shuffle_width(docs.sparkSession), -(-total // BUCKET_ROWS))
    local = rows.select("digest", "length", "doc_id", "row").mapInArrow(_local, _ENTRIES)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n)).alias("bucket")
    classes = P.checkpointed(local.groupBy(bucket).applyInArrow(_merged, _ENTRIES)).select("digest", "keep_id", "keep_row", F.col("rows").alias("group_size"))
    # texts of very many copies are at most 50,000; no task gets all rows of one
    heavy = F.broadcast(classes.where(F.col("group_size") >= P.heavy_at(total)))
    rest = rows.join(heavy.select("digest"), "digest", "left_anti").join(classes.where(F.col("group_size") < P.heavy_at(total)), "digest")
    both = rows.join(heavy, "digest").unionByName(rest) if total >= P.heavy_at(total) else rows.join(classes, "digest")
    return both.select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns unchanged: one of equal texts, by
    its row number, so that rows with one id, or without, are told apart."""
    rows, number = P.numbered(docs)
    found = _groups(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(number).alias("row")))
    return P.without_rows(rows, number, found.where("not kept"))


def update_index(live: DataFrame, changes: DataFrame) -> DataFrame:
    """live(digest, length, keep_id, keep_row, rows), one row a live member, after
    changes of the same columns, where positive rows are inserted and negative
    ones deleted, in the order: all insertions, then all deletions.  A deletion
    of what isn't live changes nothing.  Null ids are members too."""

    def apply(table: pa.Table) -> pa.Table:
        index, gone = ExactIndex(table.num_rows), []
        for digest, n, keep, row, rows in zip(*(table.column(x).to_pylist() for x in _NAMES), strict=True):
            if rows > 0:
                index.insert(digest, n, _key(keep, row), rows)
            else:
                gone.append((digest, n, _key(keep, row), -rows))
        for change in gone:
            index.delete(*change)
        return _table(index, pa.Table)

    both = live.select(_NAMES).unionByName(changes.select(_NAMES))
    bucket = F.pmod(F.xxhash64("digest", "keep_id", "keep_row"), F.lit(P.shuffle_width(live.sparkSession)))
    return both.groupBy(bucket).applyInArrow(apply, _ENTRIES)


def live_classes(live: DataFrame) -> DataFrame:
    """(digest, length, keep_id, keep_row, rows) of each live digest: the member
    that stays, and how many rows there are."""
    best = F.max(F.struct(F.col("keep_id").isNotNull(), "keep_id", (-F.col("keep_row")).alias("r"), "keep_row"))
    found = live.groupBy("digest", "length").agg(best.alias("best"), F.sum("rows").alias("rows"))
    return found.select("digest", "length", "best.keep_id", "best.keep_row", "rows")
