"""Packs of documents and keyed exchanges between them.

Duplicate searches compare billions of window hashes.  A row for each would
spend most of its time in row formats, so documents are gathered into packs of
a few megabytes.  A pack finds its distinct keys (what it holds several times is
combined, so that a key shared by a third of all documents costs one entry a
pack), and the packs of a group send them together, one row for each bucket of
the hash space.  A bucket answers each row with one code a key.

The groups of a task grow from one pack to GROUP_BYTES, so that small inputs
still spread over the cores.  Rows of an exchange are groups times buckets:
with 32 MB each, a million at 30 GB, a billion of some 80 keys at 1 TB.  Beyond
that both sizes should be raised with the executors' memory; a row needs about
1.5 bytes of requests for each byte of its group.

Packs are checkpointed (in ``spark.checkpoint.dir``), so their contents don't
change when a lost executor's tasks run again; replies meet them by
``group_id`` in a sorted cogroup, where the texts move compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.folders import new_folder, shared_folder

#: Bytes of text in a pack, unless one document is longer.
PACK_BYTES = 2 << 20
#: Bytes of text in a group of packs, and for each bucket of a keyed exchange.
GROUP_BYTES, BUCKET_BYTES = 32 << 20, 32 << 20
#: Stands for a null id: null sorts after all other ids.
NULL_ID = np.iinfo(np.int64).max
#: Rows that are broadcast at most.
BROADCAST_ROWS = 1_000_000

PACK_SCHEMA = "group_id long, pack_id long, n_bytes long, ids binary, sizes binary, text binary"
REQUEST_SCHEMA = "bucket int, level int, group_id long, parts binary, a binary, b binary, c binary"
REPLY_SCHEMA = "group_id long, level int, bucket int, parts binary, codes binary"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and stored in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a row number, written to the shared folder, so that the numbers
    stay what they are; and its column, which isn't one of df's."""
    name = "_row"
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    folder = new_folder(df.sparkSession, "numbered")
    df.withColumn(name, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder), name


def without_rows(rows: DataFrame, name: str, dropped: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The numbered rows whose number isn't among dropped(row).  Up to ``most``
    of these are broadcast, so that no text is shuffled; beyond that both sides
    are."""
    gone = checkpointed(dropped.select(F.col("row").alias(f"{name}_gone")))
    gone = F.broadcast(gone) if gone.count() <= most else gone.hint("merge")
    return rows.join(gone, F.col(name) == F.col(f"{name}_gone"), "left_anti").drop(name)


def heavy_at(n: int) -> int:
    """From how many rows of n a key counts as heavy: there are at most 50,000
    such keys, so a row for each can be broadcast."""
    return max(1000, n // 50_000)


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """The n rows, left-joined by key to a table that has a key once.  Keys of
    many rows are looked up in a broadcast of them alone, so that no task gets
    all rows of one."""
    n = rows.count() if n is None else n
    if n < heavy_at(n):
        return rows.join(table, key, "left")
    heavy = rows.groupBy(key).count().where(F.col("count") >= heavy_at(n)).select(key)
    heavy = checkpointed(heavy.join(table, key, "left").withColumn("_heavy", F.lit(True)))
    if heavy.isEmpty():
        return rows.join(table, key, "left")
    found = rows.join(F.broadcast(heavy), key, "inner").drop("_heavy")
    rest = rows.join(F.broadcast(heavy.select(F.col(key).alias("_key"))), F.col(key) == F.col("_key"), "left_anti")
    return found.unionByName(rest.join(table, key, "left"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def raw_text(text: bytes) -> bytes:
    return text


def words_text(text: bytes) -> bytes:
    """Words between white space of ASCII, one blank between them."""
    return b" ".join(text.split())


def lower_words_text(text: bytes) -> bytes:
    """As words_text, with A-Z in lower case."""
    return b" ".join(text.lower().split())


def portions(column: pa.Array, prepare: Callable[[bytes | None], bytes] | None = None, most: int = PACK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) of a column of bytes, in portions of about ``most``."""
    begin, texts, size = 0, [], 0
    for i, value in enumerate(column):
        text = prepare(value.as_py()) if prepare else value.as_py() or b""
        if texts and size + len(text) > most:
            yield begin, i, texts
            begin, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield begin, begin + len(texts), texts


def _packer(prepare: Callable[[bytes], bytes], pack_bytes: int, group_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        made, ids, texts, size = 0, [], [], 0
        group, held, room = first, 0, pack_bytes

        def flush() -> pa.RecordBatch:
            nonlocal made, ids, texts, size, group, held, room
            # packs are numbered by their first row, so that rows have numbers too
            sizes = np.array([len(t) for t in texts], np.int64)
            if held and held + size > room:
                group, held, room = first + made, 0, min(2 * room, group_bytes)
            held += size
            row = {
                "group_id": [group],
                "pack_id": [first + made],
                "n_bytes": [int(sizes.sum())],
                "ids": [np.array(ids, np.int64).tobytes()],
                "sizes": [sizes.tobytes()],
                "text": [squeeze(b"".join(texts))],
            }
            made, ids, texts, size = made + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=list(row))

        for batch in batches:
            new_ids = batch.column(0).to_pylist()
            for i, text in zip(new_ids, batch.column(1), strict=True):
                text = prepare(text.as_py() or b"")
                if texts and size + len(text) > pack_bytes:
                    yield flush()
                ids.append(NULL_ID if i is None else i)
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    return run


def pack(docs: DataFrame, prepare: Callable[[bytes], bytes] = raw_text, id_col: str = "doc_id", text_col: str = "text", pack_bytes: int = PACK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Checkpointed packs of (id, text); null texts count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return checkpointed(rows.mapInArrow(_packer(prepare, pack_bytes, group_bytes), PACK_SCHEMA))


def bucket_count(packs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    return max(shuffle_width(packs.sparkSession), -(-total // bucket_bytes))


def _wide(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt by keys to n partitions, where the session has fewer: what a
    task reads then doesn't grow with the input."""
    return df.repartition(n, *keys) if n > shuffle_width(df.sparkSession) else df


class Pack:
    """One pack, opened: buf holds the texts one after another; document i is
    buf[starts[i] : starts[i] + sizes[i]]."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, text: bytes, pack_id: int = 0, group_id: int = 0) -> None:
        self.ids, self.sizes, self.text, self.pack_id, self.group_id = ids, sizes, text, pack_id, group_id
        self.buf = np.frombuffer(text, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        #: Numbers of the documents' rows, the same whenever the pack is read.
        self.rows = pack_id + np.arange(len(ids))
        #: (level, bucket) -> codes
        self.replies: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> Pack:
        """Texts that are at hand, as a pack that isn't sent anywhere."""
        return cls(np.array([NULL_ID if i is None else i for i in ids], np.int64), np.array([len(t) for t in texts], np.int64), b"".join(texts))

    @classmethod
    def opened(cls, row: dict) -> Pack:
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64), unsqueeze(row["text"]), row["pack_id"], row["group_id"])

    def texts(self) -> list[bytes]:
        return [self.text[s:e] for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Pack.opened(batch.slice(i, 1).to_pylist()[0])


def buckets_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Rises with the key, so that sorted keys fall into slices."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def slices(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    if len(keys):
        b = buckets_of(keys, n_buckets)
        edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True):
            yield int(b[s]), s, e


#: (level, bucket, number of keys, blobs)
Request = tuple[int, int, int, tuple[bytes, ...]]


def requests(level: int, n_buckets: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[Request]:
    """What sorted keys ask of each bucket that they fall into."""
    for bucket, s, e in slices(keys, n_buckets):
        yield level, bucket, e - s, (keys[s:e].tobytes(), *(v[s:e].tobytes() for v in values))


_REQUEST_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_REQUEST_NAMES = ("bucket", "level", "group_id", "parts", "a", "b", "c")


def _request_rows(group: int, held: dict[tuple[int, int], list[tuple[int, int, tuple]]]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, with the keys of all packs of a group."""
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _REQUEST_TYPES, strict=True)], names=list(_REQUEST_NAMES))

    for (level, bucket), asked in held.items():
        parts = np.array([(pack, n) for pack, n, _ in asked], np.int64).tobytes()
        blobs = [b"".join(b) for b in zip(*(blobs for _, _, blobs in asked), strict=True)]
        rows.append((bucket, level, group, parts, *blobs, *[None] * (3 - len(blobs))))
        size += sum(map(len, blobs))
        if size > PACK_BYTES:
            yield batch()
            rows, size = [], 0
    yield batch()


def _asked(packs: Iterator[Pack], ask: Callable[[Pack], Iterator[Request]]) -> Iterator[pa.RecordBatch]:
    group, held = 0, {}
    for pack in packs:
        if pack.group_id != group and held:
            yield from _request_rows(group, held)
            held = {}
        group = pack.group_id
        for level, bucket, n, blobs in ask(pack):
            held.setdefault((level, bucket), []).append((pack.pack_id, n, blobs))
    yield from _request_rows(group, held)


def replied(pack: Pack, level: int, n_buckets: int, keys: np.ndarray) -> np.ndarray:
    """The codes for sorted keys that requests() has sent; 0 where none came."""
    out = np.zeros(len(keys), np.uint8)
    for bucket, s, e in slices(keys, n_buckets):
        codes = pack.replies.get((level, bucket))
        if codes is not None:
            out[s:e] = codes
    return out


def exchange(asked: DataFrame, n_buckets: int, answer: Callable[[int, np.ndarray, list[bytes | None], list[bytes | None]], np.ndarray]) -> DataFrame:
    """Replies to requests of n_buckets.  answer(level, keys, b, c) gets all the keys of a
    bucket, in the order of its rows, with the rows' blobs, and gives a code
    for each key.  The replies are checkpointed."""

    def reduce(table: pa.Table) -> pa.Table:
        columns = {n: table.column(n).to_pylist() for n in ("bucket", "level", "group_id", "parts", "a", "b", "c")}
        counts = [len(a) // 8 for a in columns["a"]]
        keys = np.frombuffer(b"".join(columns["a"]), np.uint64)
        codes = answer(columns["level"][0], keys, columns["b"], columns["c"])
        ends = np.cumsum(counts).tolist()
        blobs = [codes[e - n : e].tobytes() for n, e in zip(counts, ends, strict=True)]
        return pa.table([pa.array(columns["group_id"], pa.int64()), pa.array(columns["level"], pa.int32()), pa.array(columns["bucket"], pa.int32()), pa.array(columns["parts"], pa.binary()), pa.array(blobs, pa.binary())], names=["group_id", "level", "bucket", "parts", "codes"])

    return checkpointed(_wide(asked, n_buckets, "level", "bucket").groupBy("level", "bucket").applyInArrow(reduce, REPLY_SCHEMA))


def requested(packs: DataFrame, n_buckets: int, ask: Callable[[Pack], Iterator[Request]], *replies: DataFrame) -> DataFrame:
    """The requests of all packs to n_buckets; they have got ``replies``."""
    if not replies:
        return packs.mapInArrow(lambda batches: _asked(opened(batches), ask), REQUEST_SCHEMA)
    return finished(packs, n_buckets, lambda packs: _asked(packs, ask), REQUEST_SCHEMA, *replies)


def _with_codes(left: pa.Table, right: pa.Table) -> Iterator[Pack]:
    """The packs of one group, each with its codes of the group's replies."""
    codes: dict[int, dict[tuple[int, int], np.ndarray]] = {}
    for r in right.to_pylist():
        parts, at = np.frombuffer(r["parts"], np.int64).reshape(-1, 2).tolist(), 0
        width = len(r["codes"]) // sum(n for _, n in parts)
        for pack, n in parts:
            codes.setdefault(pack, {})[r["level"], r["bucket"]] = np.frombuffer(r["codes"], np.uint8, n * width, at)
            at += n * width
    for i in np.argsort(left.column("pack_id").to_numpy()).tolist():
        pack = Pack.opened(left.slice(i, 1).to_pylist()[0])
        pack.replies = codes.get(pack.pack_id, {})
        yield pack


def finished(packs: DataFrame, n_buckets: int, work: Callable[[Iterator[Pack]], Iterator[pa.RecordBatch]], schema: str, *replies: DataFrame) -> DataFrame:
    """What work makes of the packs with their replies."""
    rows = replies[0]
    for more in replies[1:]:
        rows = rows.unionByName(more)
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [b for b in work(_with_codes(left, right)) if b.num_rows]
        return pa.Table.from_batches(made) if made else empty

    left, right = (_wide(df, n_buckets, "group_id").groupBy("group_id") for df in (packs, rows))
    return left.cogroup(right).applyInArrow(run, schema)


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)
