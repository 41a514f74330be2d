"""Token totals kept up to date by signed deltas.

Each commit turns inserted, deleted and revised documents into additive totals
by source, language and tokenizer version: inserts add, deletes subtract, a
revision subtracts what was and adds what is.  A batch is stored under its own
id, and the first commit of an id counts: once more changes nothing.  Totals are
the sums over all batches, and ``compact`` folds batches into a base without
changing them.

The tokenizer's ranks are read from a path that every executor has.

Results for odd inputs: a null or empty text has no tokens but counts as a
document; null sources and languages are groups of their own; repeated rows
count each time; an empty batch takes its id and adds nothing; a batch id may
hold any characters; groups whose documents and tokens are both zero are left
out of the totals; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_GROUP = ("source", "lang", "tokenizer")
_STATE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, ranks: str, version: str, pattern: str = PATTERN, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(source, lang, tokenizer, n_tokens) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "source string, lang string, tokenizer string, n_tokens long")


def _signed(docs: DataFrame, sign: int, **options) -> DataFrame:
    return count_tokens(docs, **options).select(*_GROUP, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"))


def delta(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None, **options) -> DataFrame:
    """Signed totals of one batch; revised is (rows as they were, as they are)."""
    signed = [(inserted, 1), (deleted, -1), *(((revised[0], -1), (revised[1], 1)) if revised else ())]
    parts = [_signed(df, sign, **options) for df, sign in signed if df is not None]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*_GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share.

    ``batch=<id>`` holds the delta of a batch, ``base=<n>`` the folded totals of
    all batches listed in ``base=<n>/ids``.  Only the newest base counts, with
    the batches that it doesn't list.  Both appear by one rename of a finished
    folder, and what a newer base replaces is removed after that, so a writer
    that dies at any point leaves the totals as they were before or after.  One
    writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str = "") -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, prefix: str) -> list[str]:
        fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]

    def _remove(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    def _publish(self, unfinished: str, name: str) -> None:
        """Renames a finished folder; what is published already stays."""
        fs, target = self._fs(name)
        if fs.exists(target):
            self._remove(unfinished)
        elif not fs.rename(self._fs(unfinished)[1], target):
            raise OSError(f"Could not publish {name}")

    def _base(self) -> int | None:
        return max(map(int, self._names("base=")), default=None)

    def _folded(self) -> DataFrame | None:
        base = self._base()
        return None if base is None else self.spark.read.schema("id string").parquet(f"{self.path}/base={base}/ids")

    def is_folded(self, batch_id: str) -> bool:
        folded = self._folded()
        return folded is not None and not folded.where(F.col("id") == batch_id).isEmpty()

    def commit(self, batch_id: str, rows: DataFrame) -> None:
        """Stores a batch's delta; once more is the same as once."""
        name = f"batch={quote(batch_id, safe='')}"
        if name.removeprefix("batch=") in self._names("batch=") or self.is_folded(batch_id):
            return
        unfinished = f"unfinished-{uuid.uuid4().hex}"
        rows.select(*_GROUP, "n_docs", "n_tokens").write.parquet(f"{self.path}/{unfinished}")
        self._publish(unfinished, name)

    def batches(self) -> list[str]:
        """Ids of the batches that no base lists."""
        names, folded = sorted(map(unquote, self._names("batch="))), self._folded()
        if folded is None or not names:
            return names
        known = {r["id"] for r in folded.where(F.col("id").isin(names)).collect()}  # among the few that are there
        return [n for n in names if n not in known]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all batches."""
        return self._totals(self.batches())

    def _totals(self, batches: list[str]) -> DataFrame:
        base = self._base()
        paths = [f"{self.path}/batch={quote(b, safe='')}" for b in batches] + ([] if base is None else [f"{self.path}/base={base}/totals"])
        rows = self.spark.read.schema(_STATE).parquet(*paths) if paths else self.spark.createDataFrame([], _STATE)
        sums = rows.groupBy(*_GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds all batches into the next base; their ids are kept, so that
        none can be committed a second time."""
        batches, base, folded = self.batches(), self._base(), self._folded()
        unfinished = f"unfinished-{uuid.uuid4().hex}"
        self._totals(batches).write.parquet(f"{self.path}/{unfinished}/totals")
        ids = self.spark.createDataFrame([(b,) for b in batches], "id string")
        (ids if folded is None else ids.unionByName(folded)).write.parquet(f"{self.path}/{unfinished}/ids")
        self._publish(unfinished, f"base={0 if base is None else base + 1}")
        self.clean()

    def clean(self) -> None:
        """Removes what no longer counts: folded batches and older bases, also
        those that a dead writer left."""
        live, base = set(self.batches()), self._base()
        for b in self._names("batch="):
            if unquote(b) not in live:
                self._remove(f"batch={b}")
        for n in map(int, self._names("base=")):
            if base is not None and n < base:
                self._remove(f"base={n}")

    def drop(self) -> None:
        """Removes the folder with all that it holds."""
        fs, root = self._fs()
        fs.delete(root, True)
