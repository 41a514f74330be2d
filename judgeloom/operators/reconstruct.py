"""Reconstruction over a whole vocabulary: z = sum of p(word) * e(word), where p
is softmax(W h), without ever holding p.

The vocabulary (word, w, e) is cut into blocks.  A state keeps three things: the
largest logit so far, the sum of exp(logit - largest) and the vector that this
weighs; each block is merged into them, in any order (an online softmax).  Blocks
are broadcast, ``PASS_BYTES`` of them at a time; a larger vocabulary takes more
passes over the states, which are stored between them.  Nothing is shuffled, and
no array is longer than a block.

States without a vector, and all states if there are no words, have a null
vector.  Vectors of other lengths than the vocabulary's are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import new_folder
from .vectors import EPSILON

#: Words of a block, and bytes of vectors that are broadcast at a time.
BLOCK_ROWS, PASS_BYTES = 4096, 128 << 20

_SCHEMA = "id long, h array<double>, top double, total double, v array<double>"


def matrix(column: pa.Array) -> np.ndarray:
    """An array column without nulls as a matrix; rows of other lengths than the
    first are an error."""
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of lengths {sorted(lengths)}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), EPSILON)


def merged(top: np.ndarray, total: np.ndarray, v: np.ndarray, logits: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest logit, sum, vector) of states, with a block's logits and vectors."""
    new = np.maximum(top, logits.max(axis=1))
    kept, weights = np.exp(top - new), np.exp(logits - new[:, None])
    return new, total * kept + weights.sum(axis=1), v * kept[:, None] + weights @ e


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def reconstructed(states: DataFrame, vocabulary: DataFrame, cosine: bool = False, temperature: float = 1.0, block_rows: int = BLOCK_ROWS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(id, v) of states(id, h): v is the mean of the words' e, weighted by
    softmax(w . h / temperature), of unit vectors if cosine."""
    words = vocabulary.select("word", F.col("w").cast("array<double>").alias("w"), F.col("e").cast("array<double>").alias("e"))
    n, width = words.agg(F.count("*"), F.max(F.size("w") + F.size("e"))).first()
    rows = states.select(F.col("id").cast("long").alias("id"), F.col("h").cast("array<double>").alias("h"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("array<double>").alias("v"))
    blocks = -(-n // block_rows)
    at_once = max(1, int(pass_bytes // max(1, 8 * (width or 1) * block_rows)))
    block = F.pmod(F.xxhash64("word"), F.lit(max(1, blocks)))
    for first in range(0, blocks, at_once):
        if first:
            folder = new_folder(states.sparkSession, "softmax")
            rows.write.parquet(folder)
            rows = states.sparkSession.read.parquet(folder)
        rows = _passed(rows, words, block, range(first, min(first + at_once, blocks)), cosine, temperature)
    whole = F.transform("v", lambda x: x / F.col("total"))
    return rows.select("id", whole.alias("v"))


def _passed(rows: DataFrame, words: DataFrame, block: Column, wanted: range, cosine: bool, temperature: float) -> DataFrame:
    """rows with the wanted blocks merged in."""
    held = []
    for k in wanted:  # a block at a time comes to the driver
        own = words.where(block == k).orderBy("word").toArrow().combine_chunks()
        if own.num_rows:
            w, e = (matrix(own.column(c).combine_chunks()) for c in ("w", "e"))
            held.append((unit(w) if cosine else w, e))
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.is_valid(batch.column("h")))
            rest = batch.filter(pc.is_null(batch.column("h")))
            if some.num_rows and shared.value:
                h = matrix(some.column("h"))
                h = unit(h) if cosine else h
                if some.column("top").null_count:
                    top, total, v = np.full(len(h), -np.inf), np.zeros(len(h)), np.zeros((len(h), shared.value[0][1].shape[1]))
                else:
                    top, total, v = some.column("top").to_numpy(), some.column("total").to_numpy(), matrix(some.column("v"))
                for w, e in shared.value:
                    top, total, v = merged(top, total, v, h @ w.T / temperature, e)
                some = pa.RecordBatch.from_arrays([some.column("id"), some.column("h"), pa.array(top), pa.array(total), _lists(v)], names=some.schema.names)
            yield some
            yield rest

    return rows.mapInArrow(merge, _SCHEMA)
